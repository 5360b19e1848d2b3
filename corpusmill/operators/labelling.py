"""Labelling by an external client: prompts, retries, validation and one audit record for each row."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

_FENCE = re.compile(r"^```[A-Za-z]*\s*|\s*```$")


@dataclass(frozen=True)
class Final:
    """What the errors of a client that no retry helps against are known by: the class, a code, or words of the message.

    The values are those of the usual clients of chat models (fixed values); another client brings its own.
    """

    classes: tuple[str, ...] = ("AuthenticationError", "PermissionDeniedError")
    codes: tuple[str, ...] = ("invalid_api_key", "key_model_access_denied", "model_not_found")
    words: tuple[str, ...] = ("does not exist or you do not have access", "key not allowed to access model")

    def __call__(self, e: BaseException) -> bool:
        if str(getattr(e, "code", "")) in self.codes or any(k.__name__ in self.classes for k in type(e).__mro__):
            return True
        # a client that wraps another one keeps only what that one said
        said = str(e).casefold()
        return any(x.casefold() in said for known in (self.classes, self.codes, self.words) for x in known)


def prompt(template: str, text: Column | str, most: int = 6000, **columns: Column | str) -> Column:
    """A prompt: the template's {text} and other fields filled in, the collapsed text cut to `most` characters."""
    out = F.lit(template)
    for name, c in ({"text": F.substring(T.collapse(text), 1, most)} | columns).items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return out


def lenient_json(answer: str) -> dict:
    """The object of an answer: strictly, then with control characters, then from the first brace to the last."""
    s = _FENCE.sub("", answer.strip())
    for candidate in (s, s[s.find("{") : s.rfind("}") + 1]):
        for strict in (True, False):
            try:
                got = json.loads(candidate, strict=strict)
            except ValueError:
                continue
            if isinstance(got, dict):
                return got
    raise ValueError("no JSON object in the answer")


def label(
    df: DataFrame, id_col: str, prompt_col: str, client: Callable[[], Callable[[str], str]], validate: Callable[[dict], dict[str, str]], fields: list[str], retries: int = 3, wait: float = 0.0,
    final: Callable[[BaseException], bool] = Final(),
) -> DataFrame:
    """(id, *fields, error, raw, attempts) of every row.

    `client` makes a function from prompt to answer, once in each task. An error is retried with a wait that
    grows by the attempt, unless `final` says that it is final; a row that fails has its error and NULL fields and stops no
    other. The raw answer is kept. A NULL prompt is an error.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"{id_col} {kinds[id_col]}, {', '.join(f'{f} string' for f in fields)}, error string, raw string, attempts int"

    def run(frames):
        ask = client()
        for frame in frames:
            out = []
            for key, p in zip(frame[id_col], frame[prompt_col]):
                error, raw, got, n = "", None, {}, 0
                while n <= retries:
                    n += 1
                    try:
                        if not isinstance(p, str):
                            raise ValueError("no prompt")
                        raw = ask(p)
                        got, error = validate(lenient_json(raw)), ""
                        break
                    except Exception as e:  # whatever the client raises is recorded with the row
                        error = f"{type(e).__name__}: {e}"
                        if final(e) or not isinstance(p, str):
                            break
                        time.sleep(wait * n)
                out.append([key, *[got.get(f) for f in fields], error, raw, n])
            yield pd.DataFrame(out, columns=[id_col, *fields, "error", "raw", "attempts"])

    return df.select(id_col, prompt_col).mapInPandas(run, schema)
