"""Summaries (H10, H11) and the pluggable summariser hook.

With the offline default summariser (the first 120 words of a chunk) the
whole of H11 is one column expression over the chunk array: no explode, no
regroup, no shuffle.  A model summariser runs as an Arrow UDF over the same
`array<string>` column in a DataFrame step (`summarize_frame`), so it also
works per row without regrouping.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.chunk import CHUNK_SIZE, chunk_text
from vellum.functions.text import JS_WS, _c, bind, is_http_url, js_trim

# Generation settings for chunk and final summaries.
MAX_NEW_TOKENS = 120
MIN_LENGTH_CHUNK = 40
MIN_LENGTH_FINAL = 60


def default_summary(text, n_words: int = MAX_NEW_TOKENS) -> Column:
    """H10 offline default: the first `n_words` whitespace-separated words of the trimmed text."""
    nws = f"[^{JS_WS[1:-1]}]"
    head = F.regexp_extract(js_trim(_c(text)), f"^{nws}+(?:{JS_WS}+{nws}+){{0,{n_words - 1}}}", 0)
    return F.regexp_replace(head, f"{JS_WS}+", " ")


def _keep(sums: Column) -> Column:
    """Trimmed, non-blank summaries in chunk order."""
    return F.filter(F.transform(sums, lambda s: js_trim(s)), lambda s: F.coalesce(s != "", F.lit(False)))


def _joined(sums: Column) -> Column:
    return F.array_join(sums, " ")


def _combine(sums: Column, final: Column) -> Column:
    """0 summaries: null; 1: it; more: the final summary of the joined ones, else the joined text trimmed."""
    return (F.when(F.size(sums) == 0, F.lit(None).cast("string"))
            .when(F.size(sums) == 1, sums[0])
            .otherwise(F.coalesce(F.nullif(js_trim(final), F.lit("")), js_trim(_joined(sums)))))


def summarize_text(content, size: int = CHUNK_SIZE, max_chunks: int | None = None) -> Column:
    """H9 -> H10 -> combine, with the default summariser, as one column."""
    sums = _keep(F.transform(chunk_text(content, size, max_chunks), lambda c: default_summary(c)))
    return bind(sums, lambda s: _combine(s, default_summary(_joined(s))))


def summarize_doc(url, extracted) -> Column:
    """Guards (http url; extraction succeeded with content) then summarize_text.

    Pass the extraction as a column of its own (an attribute): it is read
    several times here, which also keeps Catalyst from folding the regex
    chain into this interpreted (higher-order) projection.
    """
    ex = _c(extracted)
    ok = is_http_url(url) & F.coalesce(ex["success"], F.lit(False)) & F.coalesce(ex["content"] != "", F.lit(False))
    return F.when(ok, summarize_text(ex["content"]))


def summarize_frame(df: DataFrame, url_col: str, extracted_col: str, out: str = "summary",
                    summarizer=None) -> DataFrame:
    """H11 as DataFrame steps; `summarizer` (U2) replaces the default when given."""
    if summarizer is None:
        return df.withColumn(out, summarize_doc(F.col(url_col), F.col(extracted_col)))
    ex = F.col(extracted_col)
    ok = is_http_url(F.col(url_col)) & F.coalesce(ex["success"], F.lit(False)) & \
        F.coalesce(ex["content"] != "", F.lit(False))
    step = df.withColumn("_chunks", F.when(ok, chunk_text(ex["content"])))
    step = step.withColumn("_sums", _keep(summarizer_udf(summarizer, MIN_LENGTH_CHUNK)(F.col("_chunks"))))
    step = step.withColumn("_final", summarizer_udf(summarizer, MIN_LENGTH_FINAL)(
        F.when(F.size("_sums") > 1, F.array(_joined(F.col("_sums"))))))
    res = F.when(F.col("_chunks").isNotNull(), _combine(F.col("_sums"), F.col("_final")[0]))
    return step.withColumn(out, res).drop("_chunks", "_sums", "_final")


def summarizer_udf(fn, min_length: int = MIN_LENGTH_CHUNK, max_new_tokens: int = MAX_NEW_TOKENS):
    """`fn(list[str], max_new_tokens, min_length) -> list[str]` as an Arrow UDF on array<string>.

    All chunks of a batch go to the model in one call; a call that raises is
    retried chunk by chunk, and a chunk that still fails gets null (it is then
    dropped, as a failed chunk summary is).
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _run(chunks: pd.Series) -> pd.Series:
        flat, owner = [], []
        for i, arr in enumerate(chunks):
            if arr is None:
                continue
            for c in arr:
                flat.append(c)
                owner.append(i)
        try:
            outs = list(fn(flat, max_new_tokens, min_length)) if flat else []
        except Exception:  # noqa: BLE001 - fall back to one call per chunk
            outs = []
            for c in flat:
                try:
                    outs.append(fn([c], max_new_tokens, min_length)[0])
                except Exception:  # noqa: BLE001
                    outs.append(None)
        res: list = [None if a is None else [] for a in chunks]
        for i, s in zip(owner, outs):
            res[i].append(s if isinstance(s, str) else None)
        return pd.Series(res)

    return _run.asNondeterministic()


def first_words_summarizer(texts, max_new_tokens: int = MAX_NEW_TOKENS, min_length: int = MIN_LENGTH_CHUNK):
    """A plain-Python summariser with the hook signature: the first max_new_tokens // 3 words."""
    import regex

    ws = regex.compile("[" + "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                               0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])) + "]+")
    out = []
    for t in texts:
        words = [w for w in ws.split(t or "")]
        if words and words[0] == "":
            words = words[1:]
        if words and words[-1] == "":
            words = words[:-1]
        out.append(" ".join(words[: max_new_tokens // 3]))
    return out
