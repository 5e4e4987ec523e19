"""Embedding (V1, V2, V3) and the pluggable embedder hook.

An embedder is any factory `make() -> f(list[str]) -> ndarray[n, d]` whose
rows are unit vectors.  Spark calls it through an Arrow `pandas_udf`, one
batch of texts at a time, with the model built once per Python worker.  The
offline default is a hashed bag of words (V2) so the whole pipeline runs
without model files.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_MODEL = "vellum/hash-embed"
DEFAULT_DIM = 64
TOKEN_PATTERN = r"[\p{L}\p{N}]+"


def _bucket(token: str, dim: int) -> int:
    """First 32 bits of md5(token), modulo dim (the same bucket the SQL form computes)."""
    return int.from_bytes(hashlib.md5(token.encode("utf-8")).digest()[:4], "big") % dim


def hash_embedder(dim: int = DEFAULT_DIM):
    """V2 factory: lower-case, take letter/digit runs, md5 bucket, mean-pool, L2-normalise.

    Mean pooling of one-hot token vectors followed by normalisation equals
    normalised bucket counts; a text without tokens maps to the zero vector.
    """

    def make():
        import regex

        tok = regex.compile(TOKEN_PATTERN)
        seen: dict[str, int] = {}

        def embed(texts):
            out = np.zeros((len(texts), dim), dtype=np.float64)
            for i, t in enumerate(texts):
                if t is None:
                    continue
                toks = tok.findall(t.lower())
                if not toks:
                    continue
                ids = []
                for w in toks:
                    b = seen.get(w)
                    if b is None:
                        if len(seen) > 1 << 20:
                            seen.clear()
                        b = seen[w] = _bucket(w, dim)
                    ids.append(b)
                counts = np.bincount(ids, minlength=dim).astype(np.float64)
                out[i] = counts / np.sqrt((counts * counts).sum())
            return out

        return embed

    return make


def pool_and_normalize(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors under the attention mask, then unit length (V1's pooling)."""
    m = mask[..., None].astype(np.float64)
    pooled = (hidden.astype(np.float64) * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1e-9)
    norm = np.linalg.norm(pooled, axis=1, keepdims=True)
    return pooled / np.where(norm == 0, 1.0, norm)


def onnx_embedder(model_dir: str, max_length: int = 256, batch_size: int = 64):
    """U1 factory for a sentence-embedding model exported to ONNX (`model.onnx` + `tokenizer.json`).

    The model is loaded once per Python worker (the factory runs there); the
    output is the token-level hidden state, mean-pooled and normalised. A text
    over `max_length` tokens goes through the model in windows of that many,
    special tokens included, and its tokens' states are pooled over all windows.
    Needs `onnxruntime` and `tokenizers`; no model files ship with this repo.
    """

    def make():
        import os

        import onnxruntime as ort
        from tokenizers import Tokenizer

        model, vocab = os.path.join(model_dir, "model.onnx"), os.path.join(model_dir, "tokenizer.json")
        if not (os.path.exists(model) and os.path.exists(vocab)):
            raise FileNotFoundError(f"expected model.onnx and tokenizer.json in {model_dir}")
        tok = Tokenizer.from_file(vocab)
        tok.enable_truncation(max_length)  # the rest comes as overflowing windows
        tok.enable_padding()
        sess = ort.InferenceSession(model, providers=["CPUExecutionProvider"])
        names = {i.name for i in sess.get_inputs()}
        pad = (tok.padding or {}).get("pad_id", 0)

        def embed(texts):
            parts = []
            for s in range(0, len(texts), batch_size):
                enc = tok.encode_batch([t or "" for t in texts[s:s + batch_size]])
                windows = [w for e in enc for w in (e, *e.overflowing)]
                owner = np.repeat(np.arange(len(enc)), [1 + len(e.overflowing) for e in enc])
                sums = counts = None
                for w in range(0, len(windows), batch_size):
                    some = windows[w:w + batch_size]
                    length = max(len(e.ids) for e in some)  # windows of a batch are padded alike, overflowing ones on their own
                    ids = np.array([e.ids + [pad] * (length - len(e.ids)) for e in some], dtype=np.int64)
                    mask = np.array([e.attention_mask + [0] * (length - len(e.ids)) for e in some], dtype=np.int64)
                    feed = {"input_ids": ids, "attention_mask": mask}
                    if "token_type_ids" in names:
                        feed["token_type_ids"] = np.zeros_like(ids)
                    hidden = sess.run(None, feed)[0].astype(np.float64) * mask[..., None]
                    if sums is None:
                        sums, counts = np.zeros((len(enc), hidden.shape[-1])), np.zeros(len(enc))
                    np.add.at(sums, owner[w:w + batch_size], hidden.sum(axis=1))
                    np.add.at(counts, owner[w:w + batch_size], mask.sum(axis=1))
                pooled = sums / np.maximum(counts, 1e-9)[:, None]
                norm = np.linalg.norm(pooled, axis=1, keepdims=True)
                parts.append(pooled / np.where(norm == 0, 1.0, norm))
            return np.vstack(parts) if parts else np.zeros((0, 0))

        return embed

    return make


_MODELS: dict = {}
KEPT_MODELS = 4


def _model(key, factory):
    fn = _MODELS.get(key)
    if fn is None:
        if len(_MODELS) >= KEPT_MODELS:  # the oldest goes; it is built again if asked for
            _MODELS.pop(next(iter(_MODELS)))
        fn = _MODELS[key] = factory()
    return fn


_EMBED_SCHEMA = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("error", T.StringType()),
])


def embed_udf(factory=None, key: str | None = None, skip_null: bool = False):
    """Wrap an embedder factory as an Arrow UDF returning {success, embedding, error}.

    A batch that raises is retried row by row so one bad text fails alone,
    as each item's failure is reported on its own.  With `skip_null` a null
    text is no item: the model does not see it and it has no success.
    Workers keep the model under `key`; without one, every wrapper has its own.
    """
    factory = factory or hash_embedder()
    key = key or uuid.uuid4().hex

    @F.pandas_udf(_EMBED_SCHEMA)
    def _embed(texts: pd.Series) -> pd.DataFrame:
        fn = _model(key, factory)
        vals = texts.tolist()
        at = [i for i, v in enumerate(vals) if not (skip_null and v is None)]
        ok, err, vecs = [False] * len(vals), [None] * len(vals), [None] * len(vals)
        try:
            found = np.asarray(fn([vals[i] for i in at]), dtype=np.float32) if at else []
            for i, vec in zip(at, found):
                ok[i], vecs[i] = True, vec
        except Exception:  # isolate the failing rows
            for i in at:
                try:
                    vecs[i] = np.asarray(fn([vals[i]]), dtype=np.float32)[0]
                    ok[i] = True
                except Exception as exc:  # noqa: BLE001 - reported per row
                    ok[i], err[i] = False, str(exc) or type(exc).__name__
        return pd.DataFrame({"success": ok, "embedding": vecs, "error": err})

    # A model call is expensive: marking it non-deterministic keeps Catalyst from
    # copying it into pushed-down filters (which would run it twice) and from
    # inlining the projection that feeds it.
    return _embed.asNondeterministic()


def predict_batch_embedder(factory=None, batch_size: int = 1024):
    """U1 through `pyspark.ml.functions.predict_batch_udf`: same factory contract, vectors only.

    Spark's helper batches the input, caches the model per Python worker and
    returns `array<float>`; use `embed_udf` when per-row failure reporting is
    needed.
    """
    from pyspark.ml.functions import predict_batch_udf

    factory = factory or hash_embedder()

    def make_predict_fn():
        fn = factory()

        def predict(texts):
            return np.asarray(fn([None if t is None else str(t) for t in texts]), dtype=np.float32)

        return predict

    return predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def embed(df: DataFrame, text_col: str = "text", factory=None, model: str = HASH_MODEL,
          out: str = "emb") -> DataFrame:
    """V1: add a struct {success, embedding, dimensions, model, text, error}."""
    from vellum.session import spread

    res = embed_udf(factory)(F.col(text_col))
    return spread(df).withColumn(out, res).withColumn(
        out,
        F.struct(
            F.col(f"{out}.success").alias("success"),
            F.col(f"{out}.embedding").alias("embedding"),
            F.when(F.col(f"{out}.success"), F.size(f"{out}.embedding")).alias("dimensions"),
            F.when(F.col(f"{out}.success"), F.lit(model)).alias("model"),
            F.col(text_col).alias("text"),
            F.when(F.col(f"{out}.success"), F.current_timestamp()).alias("timestamp"),
            F.col(f"{out}.error").alias("error"),
        ),
    )


def hash_embed(df: DataFrame, text_col: str = "text", dim: int = DEFAULT_DIM, out: str = "embedding") -> DataFrame:
    """V2 as a column: the offline stand-in model."""
    from vellum.session import spread

    res = embed_udf(hash_embedder(dim), key=f"hash-{dim}")(F.col(text_col))
    return spread(df).withColumn(out, res["embedding"])


def mean_pool(df: DataFrame, group_col: str, vec_col: str = "embedding", out: str = "embedding") -> DataFrame:
    """V3: per-group mean vector, then unit-normalised.

    `Summarizer.mean` aggregates with map-side partial sums, so a hot group
    costs one partial vector per partition, never a list of its rows.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    means = (df.where(F.col(vec_col).isNotNull())
             .groupBy(group_col)
             .agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_m")))
    arr = vector_to_array(F.col("_m"), "float64")
    norm = F.sqrt(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x * x))
    pooled = F.when(norm == 0, arr).otherwise(F.transform(arr, lambda x: x / norm))
    return means.select(group_col, pooled.alias(out))

