"""Lines repeated across one site's documents: templates from fixed-depth token trees.

Every line is parsed into templates: its words, with a wildcard slot for what stands between them without a letter
(numbers, dates, punctuation), and for short lines besides with a slot for each run of names, so that bylines fall
under one template. Templates hang in a tree of fixed depth - outlet, number of words, first word - whose leaves hold
the number of documents they cover and what their slots were filled with. Each task grows a tree over its rows; trees
are merged by adding up equal leaves, which is a partial aggregation, and templates that cover enough of an outlet's
documents are the repeated lines. Leaves without a slot that holds letters are the same if their letters are, however
these are cut into words; a leaf with names counts only if it was filled in more than one way.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.web import outlet
from corpusmill.session import materialise

#: Leaves that a task holds before it hands its tree on; more only means more trees to merge.
TREE_LEAVES = 400_000
#: Repeated templates that are broadcast to the second scan; beyond, the lines are joined instead.
BROADCAST_TEMPLATES = 500_000
#: Words of a line that may have slots for names, and words that one such slot may hold.
SHORT, NAME = 12, 4
_LETTERS = re.compile(r"[^\W\d_]+")
SLOT = "<*>"


def letters(line: str) -> str:
    """The letters of a line in lower case: lines with equal letters are the same line."""
    return "".join(_LETTERS.findall(line.lower()))


def template(line: str) -> str:
    """Tokens of a line with a slot for each run of tokens without a letter."""
    out: list[str] = []
    for t in line.split():
        x = t if any(c.isalpha() for c in t) else SLOT
        if x != SLOT or not out or out[-1] != SLOT:
            out.append(x)
    return " ".join(out)


def named(line: str) -> tuple[str, str] | None:
    """A short line with a slot for each run of names, and what filled the slots; None if it has no such run.

    Names are words with a capital after the first word, in a line that is not all capitals; what stands between them
    without a letter belongs to the slot. A line with more than NAME names in a row is a headline rather than a byline.
    """
    words = [w for t in line.split() if (w := "".join(_LETTERS.findall(t))) or t]
    first = next((i for i, w in enumerate(words) if w), None)
    if first is None or not 2 <= sum(map(bool, words)) <= SHORT or line.upper() == line:
        return None
    out, fill, run = [words[first].lower()], [], 0
    for w in words[first + 1 :]:
        if not w:
            run = 0
        elif w[0].isupper():
            run += 1
            fill.append(w.lower())
            if run > NAME:
                return None
            if out[-1] != SLOT:
                out.append(SLOT)
        else:
            run = 0
            out.append(w.lower())
    if not fill or sum(len(x) for x in out if x != SLOT) < 2:
        return None
    return " ".join(out), " ".join(fill)


def _id(host: str, key: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}\n{key}") - (1 << 63)


class Tree:
    """outlet -> number of words -> first word -> template -> [documents, example, least and greatest filling]."""

    def __init__(self):
        self.roots: dict[str, dict] = {}
        self.leaves = 0

    def add(self, host: str, found: dict[str, tuple[str, int]]) -> None:
        """The distinct templates of one document: template -> (an example of the line, hash of what filled its names)."""
        root = self.roots.setdefault(host, {})
        for key, (line, fill) in found.items():
            words = line.split()
            node = root.setdefault(len(words), {}).setdefault(words[0], {})
            leaf = node.get(key)
            if leaf is None:
                node[key] = [1, line, fill, fill]
                self.leaves += 1
            else:
                leaf[0] += 1
                leaf[2], leaf[3] = min(leaf[2], fill), max(leaf[3], fill)

    def rows(self):
        for host, root in self.roots.items():
            for heads in root.values():
                for node in heads.values():
                    for key, (n, line, low, high) in node.items():
                        # a line seen once in this tree carries no text: it is looked up again if it counts
                        yield host, _id(host, key), n, (key if SLOT in key else template(line)) if n > 1 or SLOT in key else None, SLOT in key, low, high


def _templates(text: str, slots: bool) -> dict[str, tuple[str, int]]:
    """The templates of a text's lines: letters alone, and those with slots for names."""
    found = {}
    for line in text.split("\n"):
        if k := letters(line):
            found[k] = (line, 0)
            if slots and (x := named(line)):
                h = xxhash.xxh3_64_intdigest(x[1]) >> 1
                if x[0] not in found or h < found[x[0]][1]:
                    found[x[0]] = (line, h)
    return found


def _documents(df: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))


def repeated(df: DataFrame, id_col: str, text: str, source: str, least: int = 4, share: float = 0.1, slots: bool = True) -> DataFrame:
    """(outlet, template_id, template, documents, outlet_documents): lines that recur in at least `least` documents and `share` of their outlet's.

    With `slots`, templates of short lines whose names vary are found too. A document is a distinct value of id_col; of rows that share one, the first by outlet and text is read. Documents without an outlet, NULL texts and lines without a
    letter give nothing; a line that recurs within one document counts once.
    """
    rows = _documents(df, id_col, text, source).where("source is not null")
    if _may_repeat(df, id_col):
        rows = rows.where("id is not null").groupBy("id").agg(F.min(F.struct("source", "text")).alias("x")).select("id", "x.source", "x.text")

    def grow(batches):
        tree, totals = Tree(), {}
        for b in batches:
            for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                host = outlet(s)
                if host is None:
                    continue
                totals[host] = totals.get(host, 0) + 1
                if t:
                    tree.add(host, _templates(t, slots))
            if tree.leaves >= TREE_LEAVES:
                yield _leaf_batch(tree)
                tree = Tree()
            if len(totals) >= TREE_LEAVES:
                yield _total_batch(totals)
                totals = {}
        yield _leaf_batch(tree)
        yield _total_batch(totals)

    trees = rows.mapInArrow(grow, "outlet string, leaf long, n long, template string, kind int, low long, high long")
    # leaves and totals are merged in one shuffle; an outlet's total has kind 2 and leaf 0
    added = trees.groupBy("outlet", "leaf", "kind").agg(F.sum("n").alias("n"), F.min("template").alias("template"), F.min("low").alias("low"), F.max("high").alias("high"))
    merged = materialise(added.where((F.col("kind") == 2) | (F.col("n") >= least)), "trees")
    totals = merged.where("kind = 2").select("outlet", F.col("n").alias("outlet_documents"))
    found = (
        merged.where("kind = 0 or kind = 1 and low < high")
        .join(totals, "outlet")
        .where(F.col("n") >= F.lit(share) * F.col("outlet_documents") - 1e-9)
        .select("outlet", F.col("leaf").alias("template_id"), "template", F.col("n").alias("documents"), "outlet_documents")
    )
    untold = found.where("template is null")
    if not untold.limit(1).count():
        return found
    # lines that no task saw twice: their text is looked up in another scan
    texts = _lines(rows, untold.select("template_id"))
    return found.join(texts, "template_id", "left").select("outlet", "template_id", F.coalesce("template", "line").alias("template"), "documents", "outlet_documents")


def _lines(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(template_id, line): one template for each of the ids."""

    def explode(batches):
        for b in batches:
            got = {}
            for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if t and (host := outlet(s)):
                    got |= {_id(host, k): line for line in t.split("\n") if (k := letters(line))}
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([template(x) for x in got.values()], pa.string())], ["template_id", "line"])

    return rows.mapInArrow(explode, "template_id long, line string").join(ids, "template_id", "left_semi").groupBy("template_id").agg(F.min("line").alias("line"))


def _may_repeat(df: DataFrame, id_col: str) -> bool:
    """Whether an id stands on several rows; a count of ids alone, so that texts are shuffled only if needed."""
    ids = df.select(F.col(id_col).alias("id"))
    return ids.groupBy("id").count().where("id is null or count > 1").limit(1).count() > 0


def _leaf_batch(tree: Tree) -> pa.RecordBatch:
    rows = list(zip(*tree.rows())) or [()] * 7
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(map(int, c)) if t == pa.int32() else c, t) for c, t in zip(rows, kinds)], ["outlet", "leaf", "n", "template", "kind", "low", "high"])


def _total_batch(totals: dict[str, int]) -> pa.RecordBatch:
    k, zero = len(totals), pa.array(np.zeros(len(totals), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), zero, pa.array(list(totals.values()), pa.int64()), pa.nulls(k, pa.string()), pa.array(np.full(k, 2, np.int32)), zero, zero], ["outlet", "leaf", "n", "template", "kind", "low", "high"])


def _ids(host: str, line: str, slots: bool) -> list[int]:
    """The templates that a line may fall under."""
    k = letters(line)
    if not k:
        return []
    x = named(line) if slots else None
    return [_id(host, k), _id(host, x[0])] if x else [_id(host, k)]


def _matcher(shared, slots: bool):
    """Line numbers (from 1) of a text that fall under a repeated template of its outlet."""
    known = shared.value

    def match(source: str | None, text: str | None) -> list[int]:
        host = outlet(source) if source is not None else None
        if host is None or not text:
            return []
        return [i for i, line in enumerate(text.split("\n"), 1) if any(x in known for x in _ids(host, line, slots))]

    return match


def _known(templates: DataFrame):
    """Template ids as a broadcast set, or None if there are too many."""
    ids = materialise(templates.select("template_id"), "templates")
    if ids.count() > BROADCAST_TEMPLATES:
        return ids, None
    found = {r.template_id for r in ids.toLocalIterator()}
    return ids, templates.sparkSession.sparkContext.broadcast(found)


def repeated_lines(df: DataFrame, id_col: str, text: str, source: str, least: int = 4, share: float = 0.1, slots: bool = False) -> DataFrame:
    """(id_col, line_no): every line, counted from 1, that is a repeated line of its document's outlet; with `slots`, whatever its names."""
    templates = repeated(df, id_col, text, source, least, share, slots)
    ids, shared = _known(templates)
    rows = _documents(df, id_col, text, source).where("id is not null and source is not null and text is not null")
    kind = rows.schema["id"].dataType.simpleString()
    if shared is not None:

        def scan(batches):
            match = _matcher(shared, slots)
            for b in batches:
                got = [match(s, t) for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
                at = np.repeat(np.arange(len(got)), [len(g) for g in got])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([x for g in got for x in g], pa.int64())], ["id", "line_no"])

        return rows.mapInArrow(scan, f"id {kind}, line_no long").distinct().withColumnRenamed("id", id_col)

    def explode(batches):
        for b in batches:
            for i, s, t in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if host := outlet(s):
                    got = [(n, x) for n, line in enumerate(t.split("\n"), 1) for x in _ids(host, line, slots)]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(got)), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["id", "line_no", "template_id"])

    lines = rows.mapInArrow(explode, f"id {kind}, line_no long, template_id long")
    return lines.join(ids, "template_id", "left_semi").select(F.col("id").alias(id_col), "line_no").distinct()


def without_repeated_lines(df: DataFrame, id_col: str, text: str, source: str, least: int = 4, share: float = 0.1, slots: bool = True) -> DataFrame:
    """(id_col, text, removed_lines) of every row: the text without the repeated lines of its outlet, those with varying names included.

    Texts without any come out unchanged; a NULL text stays NULL.
    """
    templates = repeated(df, id_col, text, source, least, share, slots)
    _, shared = _known(templates)
    rows = _documents(df, id_col, text, source)
    kind = rows.schema["id"].dataType.simpleString()
    if shared is None:
        gone = repeated_lines(df, id_col, text, source, least, share, slots).groupBy(id_col).agg(F.collect_set("line_no").alias("gone")).withColumnRenamed(id_col, "id")
        kept = rows.join(gone, "id", "left").withColumn("lines", F.split("text", "\n"))
        keep = F.filter("lines", lambda x, i: ~F.coalesce(F.array_contains("gone", (i + 1).cast("long")), F.lit(False)))
        return kept.select(F.col("id").alias(id_col), F.array_join(keep, "\n").alias(text), F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"))

    def strip(batches):
        match = _matcher(shared, slots)
        for b in batches:
            texts, removed = [], []
            for s, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                gone = set(match(s, t))
                removed.append(len(gone))
                texts.append("\n".join(x for i, x in enumerate(t.split("\n"), 1) if i not in gone) if gone else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], ["id", text, "removed_lines"])

    return rows.mapInArrow(strip, f"id {kind}, `{text}` string, removed_lines int").withColumnRenamed("id", id_col)
