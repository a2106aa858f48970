"""Chunking, embedding, vector ids, validation and exact nearest-vector search.

Exact k-nearest search (D6) lays queries and vectors out on a grid of blocks:
every query meets every vector in exactly one cell. A cell's rows are shuffled
together, queries first, so a task holds one bounded query block and streams the
cell's vectors past it (Arrow batches and numpy, no per-row Python), keeping the
local top-k per query. Nothing passes through the driver. A final
``row_number() <= k`` per query (planned as a WindowGroupLimit, so it is applied
before the shuffle as well) picks the global winners. Ties are broken by vector
id ascending. Equal query vectors are searched once.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import arrow_map, materialize

# Reference constants (fixed values): 512-token chunks and truncation, k = 5,
# 768-wide vectors by default.
CHUNK_SIZE = 512
MAX_TOKENS = 512
DEFAULT_K = 5
DEFAULT_DIM = 768

# Default tokenizer: runs of letters/digits/underscore, or one other
# non-space character. The same pattern runs in Java and RE2.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\r\f\x0B]"

# Query block held by a task, and vectors streamed past it (float64 bytes).
MAX_QUERY_BLOCK_BYTES = 32 << 20
VECTOR_BLOCK_BYTES = 128 << 20
# Distances (and components of differences) that a task holds at once.
BLOCK_CELLS = 1 << 20
# Bytes that a query takes besides its vector, for each of its k best vectors.
BEST_BYTES = 160
# Vectors of a cell that set the first bounds of its queries, and the most that are
# compared before the bounds are set anew; candidates per query and k from which a
# block is cut to the k least before exact distances are taken.
FIRST_VECTORS, MOST_VECTORS, MANY = 64, 4096, 32
# Rows whose token counts a Python task holds at once.
COUNTED_ROWS = 512


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --------------------------------------------------------------------------
# D1 tokenising and chunking
# --------------------------------------------------------------------------

def tokenize(text) -> Column:
    """Default tokenizer: lower-cased word and punctuation tokens."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def chunk_array(tokens, chunk_size: int = CHUNK_SIZE) -> Column:
    """Consecutive chunks of ``chunk_size``; the last one may be short; no
    tokens give no chunks."""
    t = _c(tokens)
    n = F.size(t)
    n_chunks = F.ceil(n / F.lit(chunk_size)).cast("int")
    return F.when(n <= 0, F.array().cast("array<array<string>>")).otherwise(
        F.transform(F.sequence(F.lit(0), n_chunks - 1),
                    lambda i: F.slice(t, i * chunk_size + 1, chunk_size)))


# A text above PIECE_CHARS characters is cut at white space into pieces of about
# that size, which are tokenised by themselves, so no row holds all its tokens.
# A run without white space stays whole. The tokenizer's tokens must not span
# white space; the default's do not.
PIECE_CHARS = 1 << 16


def _is_long(text_col: str) -> Column:
    return F.length(text_col) > PIECE_CHARS


def _piece_tokens(df: DataFrame, text_col: str, key_cols: list[str], tokenizer) -> DataFrame:
    """``key_cols..., _no, _tokens``: the pieces of long texts."""
    pattern = rf"(?s).{{1,{PIECE_CHARS}}}(?:\s|\z)|\S+"
    pieces = df.select(*key_cols, F.posexplode(F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))).alias("_no", "_piece"))
    return pieces.select(*key_cols, "_no", tokenizer(F.col("_piece")).alias("_tokens"))


def _long_chunks(df: DataFrame, text_col: str, key_cols: list[str], chunk_size: int, tokenizer) -> DataFrame:
    """Chunks of long texts: a piece knows how many tokens come before it in its
    text, so it deals its tokens to chunks, which gather them from one piece or more."""
    pieces = _piece_tokens(df, text_col, key_cols, tokenizer).withColumn("_n", F.size("_tokens")).filter("_n > 0")
    before = Window.partitionBy(*key_cols).orderBy("_no").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    at = lambda place: F.floor(place / F.lit(chunk_size)).cast("int")
    dealt = pieces.withColumn("chunk_no", F.explode(F.sequence(at(F.col("_before")), at(F.col("_before") + F.col("_n") - 1))))
    lo = F.greatest(F.col("chunk_no").cast("long") * chunk_size - F.col("_before"), F.lit(0)).cast("int")
    hi = F.least((F.col("chunk_no") + 1).cast("long") * chunk_size - F.col("_before"), F.col("_n")).cast("int")
    part = F.struct("_no", F.slice("_tokens", lo + 1, hi - lo).alias("t"))
    return dealt.groupBy(*key_cols, "chunk_no").agg(F.array_sort(F.collect_list(part)).alias("_parts")) \
        .select(*key_cols, "chunk_no", F.flatten(F.transform("_parts", lambda p: p["t"])).alias("tokens"))


def chunk_tokens(df: DataFrame, text_col: str, key_cols: list[str],
                 chunk_size: int | None = CHUNK_SIZE, tokenizer=tokenize) -> DataFrame:
    """One row per chunk: ``key_cols..., chunk_no, tokens``. ``chunk_size=None``
    keeps the whole text as one chunk (D8, whole-file embedding). ``key_cols``
    identify a text; long texts are cut up first, with the same chunks."""
    if chunk_size is None:
        return df.select(*key_cols, F.lit(0).alias("chunk_no"), tokenizer(F.col(text_col)).alias("tokens"))
    short = df.filter(~_is_long(text_col)).select(*key_cols, F.posexplode(chunk_array(tokenizer(F.col(text_col)), chunk_size))
                                                  .alias("chunk_no", "tokens"))
    long = _long_chunks(df.filter(_is_long(text_col)), text_col, key_cols, chunk_size, tokenizer)
    return short.withColumn("chunk_no", F.col("chunk_no").cast("int")).unionByName(long)


def chunk_counts(df: DataFrame, text_col: str, key_cols: list[str],
                 chunk_size: int | None = CHUNK_SIZE, tokenizer=tokenize) -> DataFrame:
    """``key_cols..., n_chunks``: how many chunks ``chunk_tokens`` makes of each text."""
    if chunk_size is None:
        return df.select(*key_cols, F.lit(1).alias("n_chunks"))
    short = df.filter(~F.coalesce(_is_long(text_col), F.lit(False))) \
        .select(*key_cols, chunk_count(tokenizer(F.col(text_col)), chunk_size).alias("n_chunks"))
    n = F.sum(F.size("_tokens"))
    long = _piece_tokens(df.filter(_is_long(text_col)), text_col, key_cols, tokenizer) \
        .groupBy(*key_cols).agg(F.ceil(n / F.lit(chunk_size)).cast("int").alias("n_chunks"))
    return short.unionByName(long)


# --------------------------------------------------------------------------
# D2/D3 embedding
# --------------------------------------------------------------------------

class HashedEmbedder:
    """Model-free default embedder: hashed term counts, L2-normalised, float32.

    Each token goes to bucket ``int(md5(token)[0:8], 16) mod dim``; the first
    ``max_tokens`` tokens count (the reference truncates model input at 512).
    Tokenising is a JVM expression; hashing (the different tokens of a slice of rows,
    once each), counting and normalising run as one vectorised numpy pass per slice
    (``bincount`` over all its rows, no per-row Python).
    """

    def __init__(self, dim: int = DEFAULT_DIM, max_tokens: int = MAX_TOKENS):
        self.dim = dim
        self.max_tokens = max_tokens

    def embed_tokens(self, df: DataFrame, tokens_col: str, out_col: str = "embedding",
                     keys: list[str] | None = None) -> DataFrame:
        """``keys``: the columns to keep (all by default); naming them spares
        the others, texts above all, the way to Python and back."""
        kept = df.columns if keys is None else keys
        read = F.slice(F.col(tokens_col), 1, self.max_tokens).cast("array<string>")
        staged = df.select(*kept, read.alias("_read"))
        out_schema = T.StructType([f for f in staged.schema.fields if f.name not in (out_col, "_read")]
                                  + [T.StructField(out_col, T.ArrayType(T.FloatType()))])
        return arrow_map(staged, _token_counts_fn(self.dim, out_col, list(out_schema.names)), out_schema)

    def embed_text(self, df: DataFrame, text_col: str, out_col: str = "embedding",
                   keys: list[str] | None = None) -> DataFrame:
        staged = df.withColumn("_tokens", tokenize(F.col(text_col)))
        return self.embed_tokens(staged, "_tokens", out_col, df.columns if keys is None else keys)


def _token_counts_fn(dim: int, out_col: str, names: list[str]):
    """``_bucket_counts_fn`` of rows of tokens."""
    count = _bucket_counts_fn(dim, out_col, names)

    def hashed(batches):
        for rb in batches:
            for lo in range(0, rb.num_rows, COUNTED_ROWS):
                some = rb.slice(lo, COUNTED_ROWS)
                at = some.schema.get_field_index("_read")
                yield some.set_column(at, "_buckets", _buckets(some.column(at), dim))
    return lambda batches: count(hashed(batches))


def _buckets(tokens: pa.ListArray, dim: int) -> pa.ListArray:
    """The buckets of each row's tokens; a token that repeats is hashed once."""
    coded = tokens.flatten().dictionary_encode()
    digests = b"".join(hashlib.md5(t, usedforsecurity=False).digest() for t in coded.dictionary.cast(pa.binary()).to_pylist())
    bucket = np.frombuffer(digests, ">u4")[::4].astype(np.int64) % dim
    ends = np.cumsum(np.r_[0, tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket[coded.indices.to_numpy(zero_copy_only=False)]),
                                    mask=pa.array(tokens.is_null().to_numpy(zero_copy_only=False)))


def _bucket_counts_fn(dim: int, out_col: str, names: list[str]):
    def counted(rb):
        b = rb.column(rb.schema.get_field_index("_buckets"))
        n = len(b)
        lens = b.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        vals = b.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(n, dtype=np.int64), lens)
        counts = np.bincount(row * dim + vals, minlength=n * dim).reshape(n, dim).astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", counts, counts))
        safe = np.where(norm > 0, norm, 1.0)
        vec = (counts / safe[:, None]).astype(np.float32)
        offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
        emb = pa.ListArray.from_arrays(offsets, pa.array(vec.ravel(), pa.float32()),
                                       mask=pa.array(b.is_null().to_numpy(zero_copy_only=False)))
        cols = [emb if name == out_col else rb.column(rb.schema.get_field_index(name))
                for name in names]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches):
        for rb in batches:
            for lo in range(0, rb.num_rows, COUNTED_ROWS):
                yield counted(rb.slice(lo, COUNTED_ROWS))
    return run


def embed(df: DataFrame, text_col: str, embedder=None, out_col: str = "embedding") -> DataFrame:
    """Embed a text column (D2). ``embedder`` is any object with
    ``embed_text(df, text_col, out_col) -> DataFrame``; a model-backed embedder
    can implement it with an iterator pandas UDF that loads the model once per
    Python worker."""
    embedder = embedder or HashedEmbedder()
    return embedder.embed_text(df, text_col, out_col)


def embed_chunks(chunks: DataFrame, embedder=None, tokens_col: str = "tokens",
                 out_col: str = "embedding") -> DataFrame:
    """Embed pre-chunked tokens (D3); the embedder truncates each chunk again."""
    embedder = embedder or HashedEmbedder()
    return embedder.embed_tokens(chunks, tokens_col, out_col)


# --------------------------------------------------------------------------
# D4 ids shared by code chunks and documents
# --------------------------------------------------------------------------

def assign_embedding_ids(code_chunks: DataFrame, doc_rows: DataFrame, start=0) -> DataFrame:
    """Dense ids over code chunks and documents together, in (file_path,
    chunk_no) order -- one id per code chunk, one per document.

    ``code_chunks``: file_path, chunk_no, ...; ``doc_rows``: file_path, ....
    Returns ``embedding_id, kind, file_path, chunk_no`` plus shared columns.
    Ranks rows directly; ``number_chunks`` is the cheaper form when the rows
    are expensive to compute.
    """
    from .ids import dense_ids
    code = code_chunks.withColumn("kind", F.lit("code"))
    docs = doc_rows.withColumn("chunk_no", F.lit(0)).withColumn("kind", F.lit("doc"))
    both = code.unionByName(docs, allowMissingColumns=True)
    return dense_ids(both, ["file_path", "chunk_no"], "embedding_id", start=start)


def file_first_ids(code_counts: DataFrame, doc_files: DataFrame, start=0) -> DataFrame:
    """D4 at file level: ``file_path, kind, first_id, n_chunks`` where code file ``f``
    with ``n_chunks`` chunks owns ids ``first_id .. first_id + n_chunks - 1``
    and each document owns one id, all dense in file-path order.

    ``code_counts``: file_path, n_chunks; ``doc_files``: file_path."""
    from .ids import dense_offsets
    files = code_counts.select("file_path", F.col("n_chunks").cast("long").alias("n_chunks"),
                               F.lit("code").alias("kind")) \
        .unionByName(doc_files.select("file_path", F.lit(1).cast("long").alias("n_chunks"),
                                      F.lit("doc").alias("kind")))
    return dense_offsets(files.filter(F.col("n_chunks") > 0), ["file_path"], "n_chunks",
                         "first_id", start=start).select("file_path", "kind", "first_id", "n_chunks")


def number_chunks(first_ids: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Chunk keys from the file table of ``file_first_ids``: ``embedding_id,
    kind, file_path, chunk_no`` (``counts`` is not needed: the table has them)."""
    last = (F.col("n_chunks") - 1).cast("int")
    return first_ids.select(F.posexplode(F.sequence(F.lit(0), last)).alias("chunk_no", "_x"),
                    "first_id", "kind", "file_path") \
            .select((F.col("first_id") + F.col("chunk_no")).alias("embedding_id"), "kind", "file_path",
                    F.col("chunk_no").cast("int").alias("chunk_no"))


def chunk_count(tokens, chunk_size: int | None = CHUNK_SIZE) -> Column:
    """How many chunks ``chunk_array`` makes of a token array."""
    n = F.size(_c(tokens))
    if chunk_size is None:
        return F.lit(1)
    return F.when(n <= 0, F.lit(0)).otherwise(F.ceil(n / F.lit(chunk_size)).cast("int"))


def ids_per_file(vectors: DataFrame) -> DataFrame:
    """``file_path -> embedding_ids`` in chunk order, for the file records."""
    return (vectors.groupBy("file_path", "kind")
                   .agg(F.array_sort(F.collect_list(F.struct("chunk_no", "embedding_id")))
                        .alias("_ids"))
                   .select("file_path", "kind",
                           F.transform("_ids", lambda x: x["embedding_id"]).alias("embedding_ids")))


# --------------------------------------------------------------------------
# D5 validation
# --------------------------------------------------------------------------

def bad_vector(vec_col: str, dim: int) -> Column:
    v = F.col(vec_col)
    return (v.isNull() | (F.size(v) != dim)
            | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def check_vectors(vectors: DataFrame, dim: int, vec_col: str = "embedding") -> DataFrame:
    """One row: rows, bad rows (wrong width, null, NaN or infinite entries)."""
    return vectors.agg(F.count(F.lit(1)).alias("n_rows"),
                       F.count_if(bad_vector(vec_col, dim)).alias("n_bad"))


def validate_vectors(vectors: DataFrame, dim: int, vec_col: str = "embedding"):
    """Split into (good, quarantine) by the D5 rule."""
    bad = bad_vector(vec_col, dim)
    return vectors.filter(~bad), vectors.filter(bad).withColumn(
        "error", F.lit(f"embedding must have {dim} finite float entries"))


def append_vectors(store, vectors: DataFrame, dim: int, name: str = "vectors",
                   vec_col: str = "embedding") -> int:
    """Append vectors to the store after the D5 check; any row that is not
    ``dim`` finite floats refuses the whole append (``ValueError``)."""
    chk = check_vectors(vectors, dim, vec_col).first()
    if chk["n_bad"]:
        raise ValueError(f"{chk['n_bad']} vectors are not {dim} finite floats")
    store.append(name, vectors, partition_by=["kind"] if "kind" in vectors.columns else None)
    return chk["n_rows"]


# --------------------------------------------------------------------------
# D6/D7 exact k-nearest
# --------------------------------------------------------------------------

def _to_matrix(list_array: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrow list<float> -> (n x dim float64 matrix, valid mask): rows of the
    right width with finite entries only (a null entry counts as NaN)."""
    lengths = list_array.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    valid = lengths == dim
    out = np.zeros((len(list_array), dim))
    if valid.any():
        rows = list_array if valid.all() else list_array.filter(pa.array(valid))
        out[valid] = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    return out, valid & np.isfinite(out).all(axis=1)


def _topk_pairs(qi, vid, dist, key, k):
    """Keep the k smallest (key, id) per query index."""
    if len(qi) == 0:
        return qi, vid, dist, key
    order = np.lexsort((vid, key, qi))
    qs = qi[order]
    starts = np.r_[0, np.nonzero(np.diff(qs))[0] + 1]
    sizes = np.diff(np.r_[starts, len(qs)])
    rank = np.arange(len(qs)) - np.repeat(starts, sizes)
    keep = order[rank < k]
    return qi[keep], vid[keep], dist[keep], key[keep]


def _rank_key(dist, rank_decimals):
    if rank_decimals is None:
        return dist
    return np.floor(dist * (10.0 ** rank_decimals) + 0.5)


def _least_ids(V, vids, k):
    """Vectors by ascending id, of equal ones only the ``k`` with the least ids:
    no other can be among the k nearest of a query."""
    order = np.argsort(vids, kind="stable")
    V, vids = V[order], vids[order]
    V += 0.0  # no negative zeros
    bits = V.view(np.dtype((np.void, 8 * V.shape[1]))).ravel()
    _, same = np.unique(bits, return_inverse=True)
    by = np.argsort(same, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(same[by])) + 1]
    nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    kept = np.sort(by[nth < k])
    return V[kept], vids[kept]


def _exact(V, Q, rows, cols):
    """Sums of squared differences of the pairs, a bounded number at a time."""
    out = np.empty(len(rows))
    step = max(1, BLOCK_CELLS // max(1, V.shape[1]))
    for s in range(0, len(rows), step):
        diff = V[rows[s:s + step]] - Q[cols[s:s + step]]
        out[s:s + step] = np.einsum("ij,ij->i", diff, diff)
    return out


def _least_k(key, k):
    """Per column the ``k`` least entries, equal ones by ascending row."""
    m = min(k, len(key))
    kth = np.partition(key, m - 1, axis=0)[m - 1]
    below = key < kth
    tied = key == kth
    return below | (tied & (np.cumsum(tied, axis=0, dtype=np.int32) <= m - below.sum(axis=0)))


def _knn_block(V, vids, Q, qidx, k, rank_decimals, worst=None):
    """At most ``k`` exact candidates for each of the queries ``Q`` (rows
    ``qidx``) among vectors ``V``, least (key, id) first.

    The |v|^2 + |q|^2 - 2 v.q expansion (BLAS) decides wherever its rounding
    error cannot matter; entries that it leaves open -- about as far as the
    k-th, or about to round to another key -- are replaced by a sum of squared
    differences before the k least are taken. All arrays are bounded by
    BLOCK_CELLS, however many vectors tie.

    ``worst``, the k-th least key that each query has from earlier blocks (infinite
    while it has fewer), spares that where few vectors come below it: single precision
    tells the pairs that may, only those get exact distances, and all that are no
    farther are returned, in any order.
    """
    out = [], [], [], []
    if len(V) == 0 or len(Q) == 0:
        return out
    V, vids = _least_ids(V, vids, k)
    vn = np.einsum("ij,ij->i", V, V)
    qn = np.einsum("ij,ij->i", Q, Q)
    left = np.hstack([V, vn[:, None], np.ones((len(V), 1))])
    right = np.hstack([-2.0 * Q, np.ones((len(Q), 1)), qn[:, None]])
    err = 16 * np.finfo(float).eps * V.shape[1] * (vn.max() + qn) + 1e-300
    single = None
    if worst is not None:
        unit = 0 if rank_decimals is None else 10.0 ** -rank_decimals
        single = _in_single(left, right, worst * (unit or 1.0) + unit + 2 * err)
    step = max(1, BLOCK_CELLS // len(V))
    product = np.empty((min(step, len(Q)), len(V)), np.float32)  # new ones would cost more than the products
    below = np.zeros(-(-product.size // 8) * 8, bool)
    for s in range(0, len(Q), step):
        Qs, errs = Q[s:s + step], err[s:s + step]
        at = None
        if single is not None and single[2][s:s + step].all():
            n = len(Qs) * len(V)
            np.matmul(single[1][s:s + step], single[0].T, out=product[:len(Qs)])
            np.less_equal(product[:len(Qs)].reshape(-1), 0, out=below[:n])
            below[n:] = False
            if np.count_nonzero(below) <= MANY * k * len(Qs):
                at = _places(below)
        if at is not None:
            cols, rows = np.divmod(at, len(V))
            dist = _exact(V, Qs, rows, cols)
            kept = _rank_key(dist, rank_decimals) <= worst[s:s + step][cols]
            rows, cols, dist = rows[kept], cols[kept], dist[kept]
        else:
            rows, cols, dist = _least_pairs(left @ right[s:s + step].T, V, Qs, errs, k, rank_decimals)
        out[0].append(qidx[s:s + step][cols])
        out[1].append(vids[rows])
        out[2].append(dist)
        out[3].append(_rank_key(dist, rank_decimals))
    return out


def _places(flags):
    """Where ``flags`` (a multiple of eight of them) are true, eight looked at at once: few are."""
    some = np.flatnonzero(flags.view(np.uint64))
    eight, nth = np.nonzero(flags.reshape(-1, 8)[some])
    return some[eight] * 8 + nth


def _in_single(left, right, limit):
    """Single-precision factors whose product is at most 0 wherever that of ``left``
    and ``right`` is at most ``limit`` (of each row of ``right``), and for which rows
    that holds: not for those without a limit or near the ends of that precision.

    With ``top`` at least half the sum of its terms' sizes, a product of ``n`` terms is off
    by less than ``(n + 8) * eps * top``, whatever the order of the sum; twice that is allowed."""
    n = left.shape[1]
    top = left[:, -2].max() + right[:, -1] + np.abs(limit)
    fits = top < 1e30
    shift = np.where(fits, right[:, -1] - limit - 2 * (n + 8) * np.finfo(np.float32).eps * top - 1e-30, 0.0)
    low = np.where(fits[:, None], right, 0.0)
    low[:, -1] = shift
    if not fits.any():
        return None
    return left.astype(np.float32), low.astype(np.float32), fits


def _least_pairs(key, V, Qs, err, k, rank_decimals):
    """The ``k`` least of each column of ``key`` (distances up to ``err``) and their exact distances."""
    m = min(k, len(V))
    kth = np.partition(key, m - 1, axis=0)[m - 1]
    near = key <= (kth + 2 * err + (0 if rank_decimals is None else 10.0 ** -rank_decimals))[None, :]
    if rank_decimals is None:
        near &= key >= (kth - 2 * err)[None, :]
    else:
        near &= _rank_key(key - err, rank_decimals) != _rank_key(key + err, rank_decimals)
    rows, cols = np.nonzero(near)
    key[rows, cols] = _exact(V, Qs, rows, cols)
    rows, cols = np.nonzero(_least_k(_rank_key(key, rank_decimals), k))
    return rows, cols, _exact(V, Qs, rows, cols)


class _Cell:
    """One cell of the grid: its queries, then the best vectors so far."""

    def __init__(self, dim: int, k: int, rank_decimals, with_class: bool):
        self.dim, self.k, self.rank_decimals, self.with_class = dim, k, rank_decimals, with_class
        self.held: list[tuple] = []
        self.queries = None
        self.seen = 0
        self.best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]

    def add_queries(self, rb) -> None:
        Q, valid = _to_matrix(rb.column("vec"), self.dim)
        ids = rb.column("query_id").to_numpy(zero_copy_only=False)
        cls = np.array(rb.column("cls").to_pylist(), dtype=object)[valid] if self.with_class else None
        self.held.append((ids[valid], Q[valid], cls))

    def add_vectors(self, rb) -> None:
        """Vectors of an Arrow batch, so many at a time that they stay small: as many
        as there were before, so that few of them come below the bounds those set."""
        most, lo = max(64, min(MOST_VECTORS, BLOCK_CELLS // self.dim)), 0
        while lo < rb.num_rows:
            some = min(most, max(FIRST_VECTORS, self.seen))
            self._add(rb.slice(lo, some))
            self.seen += some
            lo += some

    def _add(self, rb) -> None:
        if self.queries is None:
            if not self.held:
                return
            ids, Q, cls = zip(*self.held)
            self.queries = np.concatenate(ids), np.concatenate(Q), np.concatenate(cls) if self.with_class else None
            self.held = []
        ids, Q, cls = self.queries
        V, valid = _to_matrix(rb.column("vec"), self.dim)
        vids = rb.column("embedding_id").to_numpy(zero_copy_only=False).astype(np.int64)[valid]
        V = V[valid]
        if self.with_class:
            vcls = np.array(rb.column("cls").to_pylist(), dtype=object)[valid]
            groups = [(V[vcls == c], vids[vcls == c], Q[cls == c], np.flatnonzero(cls == c)) for c in set(cls.tolist())]
        else:
            groups = [(V, vids, Q, np.arange(len(Q)))]
        worst = self._worst(len(Q))
        parts = [], [], [], []
        for Vg, vg, Qg, qg in groups:
            for part, got in zip(parts, _knn_block(Vg, vg, Qg, qg, self.k, self.rank_decimals, worst[qg])):
                part.extend(got)
        if any(len(x) for x in parts[0]):
            self._merge([np.concatenate(x) for x in parts])

    def _merge(self, got) -> None:
        """Only the queries that ``got`` has something for are ranked again."""
        changed = np.zeros(len(self.queries[1]), bool)
        changed[got[0]] = True
        again = changed[self.best[0]]
        new = _topk_pairs(*(np.concatenate([x[again], y]) for x, y in zip(self.best, got)), self.k)
        best = [np.concatenate([x[~again], y]) for x, y in zip(self.best, new)]
        order = np.argsort(best[0], kind="stable")  # two sorted runs; a query's rows stay in order
        self.best = [x[order] for x in best]

    def _worst(self, n: int) -> np.ndarray:
        """The k-th least key of each query so far; ``best`` is in order of query and key."""
        worst, at, key = np.full(n, np.inf), self.best[0], self.best[3]
        if len(at):
            last = np.flatnonzero(np.r_[at[1:] != at[:-1], True])
            full = np.diff(np.r_[-1, last]) == self.k
            worst[at[last[full]]] = key[last[full]]
        return worst

    def result(self) -> pa.RecordBatch | None:
        if self.queries is None or not len(self.best[0]):
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(self.queries[0][self.best[0]], pa.int64()), pa.array(self.best[1], pa.int64()),
             pa.array(self.best[2], pa.float64()), pa.array(self.best[3], pa.float64())],
            names=["query_id", "embedding_id", "dist", "_key"])


def _grid_fn(dim: int, k: int, rank_decimals, with_class: bool):
    """Rows arrive ordered by cell, a cell's queries (side 0) before its vectors."""
    def run(batches):
        cell, at = None, None
        for rb in batches:
            key = rb.column("cell").to_numpy(zero_copy_only=False)
            side = rb.column("side").to_numpy(zero_copy_only=False)
            turns = np.flatnonzero((np.diff(key) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *turns], [*turns, len(key)]):
                if hi == lo:
                    continue
                if at != key[lo]:
                    if cell is not None and (out := cell.result()) is not None:
                        yield out
                    cell, at = _Cell(dim, k, rank_decimals, with_class), key[lo]
                (cell.add_vectors if side[lo] else cell.add_queries)(rb.slice(lo, hi - lo))
        if cell is not None and (out := cell.result()) is not None:
            yield out
    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT_K, *,
        vec_id: str = "embedding_id", vec_col: str = "embedding",
        query_id: str = "query_id", query_col: str = "embedding",
        same_class: tuple[str, str] | None = None, rank_decimals: int | None = None,
        max_block_bytes: int = MAX_QUERY_BLOCK_BYTES,
        vector_block_bytes: int = VECTOR_BLOCK_BYTES) -> DataFrame:
    """Exact k nearest vectors by squared L2 for every query row.

    Returns ``query_id, embedding_id, dist, rank`` (rank 1..k; fewer rows when
    fewer vectors qualify -- no -1 padding). ``same_class=(vector_col,
    query_col)`` restricts each query to vectors of its own class (D7).
    ``rank_decimals`` makes distances equal to that many decimals tie (then
    the id decides), which keeps rankings stable across engines.
    Vectors with a wrong width or null, NaN or infinite entries are skipped
    (see D5), and so are queries with such entries.
    """
    spark = vectors.sparkSession
    with_class = same_class is not None
    qid_sql = "string" if isinstance(queries.schema[query_id].dataType, T.StringType) else "long"
    # floats are exact as doubles, and half their size in a shuffle
    both = {df.schema[c].dataType.simpleString() for df, c in ((vectors, vec_col), (queries, query_col))}
    vec_sql = "array<float>" if both == {"array<float>"} else "array<double>"
    cls = [F.col(c).cast("string").alias("cls") if with_class else F.lit(None).cast("string").alias("cls")
           for c in (same_class or ("", ""))]
    q = queries.select(F.col(query_id).cast(qid_sql).alias("query_id"), F.col(query_col).cast(vec_sql).alias("vec"), cls[1])
    v = vectors.select(F.lit(None).cast("long").alias("query_id"), F.col(vec_id).cast("long").alias("embedding_id"),
                       F.col(vec_col).cast(vec_sql).alias("vec"), cls[0]).filter("vec IS NOT NULL")
    if with_class:
        q, v = q.filter("cls IS NOT NULL"), v.filter("cls IS NOT NULL")
    q = q.filter("vec IS NOT NULL").transform(materialize)
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d"), F.min(F.size("vec")).alias("d0")).first()
    dim = stats["d"]
    if not stats["n"]:
        return spark.createDataFrame([], f"query_id {qid_sql}, embedding_id long, dist double, rank int")
    if stats["d0"] != dim:
        raise ValueError(f"query vectors must all have the same width; saw {stats['d0']}..{dim}")
    # equal vectors (of a class) have the same answer: each is searched once
    alike = ["vec", "cls"] if with_class else ["vec"]
    searched = q.select(*alike).distinct().withColumn("_q", F.monotonically_increasing_id()).transform(materialize)
    q_blocks = max(1, math.ceil(searched.count() * (8 * dim + BEST_BYTES * k) / max_block_bytes))
    # some cells for each core, so that none waits for a core that has one more
    v_blocks = max(math.ceil(4 * spark.sparkContext.defaultParallelism / q_blocks), math.ceil(v.count() * 8 * dim / vector_block_bytes))
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    each = searched.select(F.col("_q").alias("query_id"), F.lit(None).cast("long").alias("embedding_id"), "vec",
                           F.col("cls") if with_class else F.lit(None).cast("string").alias("cls"))
    grid = (each.withColumn("qb", block("query_id", q_blocks)).withColumn("vb", every(v_blocks)).withColumn("side", F.lit(0))
            .unionByName(v.withColumn("qb", every(q_blocks)).withColumn("vb", block("embedding_id", v_blocks))
                         .withColumn("side", F.lit(1))))
    # each block has a task of its own: hashed to tasks, some would get several and others none
    n_cells, task = q_blocks * v_blocks, F.col("qb") * v_blocks + F.col("vb")
    cell = F.xxhash64("qb", "vb", "cls") if with_class else task
    if with_class:  # the classes of a block are spread
        task = F.pmod(cell, F.lit(n_cells))
    rows = (grid.select(cell.cast("long").alias("cell"), "side", "query_id", "embedding_id", "vec", "cls", task.cast("int").alias("_task"))
            .repartitionById(n_cells, "_task").drop("_task").sortWithinPartitions("cell", "side"))
    partial = arrow_map(rows, _grid_fn(dim, k, rank_decimals, with_class),
                        "query_id long, embedding_id long, dist double, _key double")
    least = lambda df, of: df.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy("_key", "embedding_id"))) \
        .filter(F.col("rank") <= k)
    best = least(partial.withColumnRenamed("query_id", "_q"), "_q").drop("rank")
    asked = q.join(searched, alike).select("query_id", "_q")
    return least(asked.join(best, "_q"), "query_id").select("query_id", "embedding_id", "dist", F.col("rank").cast("int"))
