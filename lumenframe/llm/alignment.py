"""Two tokenizers' tokens aligned by bytes, with corpus-wide counts of the id pairs that they link.

A shard is the text of some documents.  Its distinct chunks (chunks.py: both
tokenizers break at their borders) are encoded once; DuckDB holds the token
intervals of both as tables on one axis of bytes, finds by ASOF joins which
token of the other side overlaps each token's end, numbers the groups by window
sums, and joins the two sides of each group into id pairs per chunk.  It also
counts in how many of the shard's documents each pair is linked: the partial
counts, which Spark sums.  Each shard then gets the sums of its own pairs back,
grouped by shard, and every document's sums follow from its chunks.

A document's groups are those of its chunks in order, as both tokenizers end a
token at each chunk's end.  Chunks whose tokens don't give their bytes back (a
text that holds a space mark itself) void the documents they are in.

Texts that are null, empty or void have no tokens: zeros and ''.  Repeated rows
and doc_ids are documents each for itself; null doc_ids stay null.  A long text
is one document of one shard; a group's pairs are counted by ids, never one by
one.  No documents give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.chunks import ByteLevel, Pieces, buffers, gather, split
from lumenframe.llm.common import give_back, own_columns, save

SHARD_BYTES, SLICE_BYTES, DOC_BLOCK = 4 << 20, 2 << 20, 1000
_PER_DOC = ["n_a", "n_b", "n_groups", "n_links"]
_SHARD = (
    "shard long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string>>, "
    "doc_ends binary, chunks binary, times binary, chunk_ends binary, pairs binary, links binary, a array<int>, b array<int>, in_docs array<int>"
)

GROUPS_SQL = """
CREATE OR REPLACE TEMP TABLE a AS SELECT * FROM tokens_a;
CREATE OR REPLACE TEMP TABLE b AS SELECT * FROM tokens_b;
CREATE OR REPLACE TEMP TABLE a_groups AS
    SELECT chunk, id, start, stop, coalesce(sum(ends_together::INT) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS g
    FROM (SELECT a.*, b.stop = a.stop AS ends_together FROM a ASOF JOIN b ON a.stop > b.start);
CREATE OR REPLACE TEMP TABLE spans AS SELECT g, min(chunk) AS chunk, min(start) AS start, max(stop) AS stop, count(*) AS n_a FROM a_groups GROUP BY g;
CREATE OR REPLACE TEMP TABLE b_groups AS SELECT b.chunk, b.id, b.start, b.stop, spans.g FROM b ASOF JOIN spans ON b.start >= spans.start;
"""
PAIRS_SQL = """
CREATE OR REPLACE TEMP TABLE links AS
    SELECT chunk, a, b, sum(n)::INT AS n
    FROM (SELECT x.chunk, x.id AS a, y.id AS b, x.n * y.n AS n
          FROM (SELECT chunk, g, id, count(*) AS n FROM a_groups GROUP BY ALL) x JOIN (SELECT g, id, count(*) AS n FROM b_groups GROUP BY ALL) y USING (g))
    GROUP BY ALL;
CREATE OR REPLACE TEMP TABLE pairs AS SELECT a, b, (row_number() OVER (ORDER BY count(*) DESC, a, b) - 1)::INT AS pair FROM links GROUP BY a, b;
CREATE OR REPLACE TEMP TABLE chunk_pairs AS SELECT chunk, pair, n FROM links JOIN pairs USING (a, b) ORDER BY chunk, pair;
"""
PER_CHUNK_SQL = """
SELECT chunk, sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b, count(*)::BIGINT AS n_groups, sum(n_a * n_b)::BIGINT AS n_links
FROM spans JOIN (SELECT g, count(*) AS n_b FROM b_groups GROUP BY g) USING (g) GROUP BY chunk
"""
PARTIAL_SQL = "SELECT pair, count(*)::INT AS in_docs FROM (SELECT DISTINCT doc, pair FROM doc_chunks JOIN chunk_pairs USING (chunk)) GROUP BY pair"


def _packed(values: np.ndarray) -> bytes:
    """Integers below 2**32, byte by byte of all, compressed, behind their number."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Aligner:
    """Both tokenizers and a DuckDB connection of one task."""

    def __init__(self):
        import duckdb

        self.a, self.b = ByteLevel(special=False), Pieces()
        self.tables = [gather_table(x.bytes_of) for x in (self.a, self.b)]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "preserve_insertion_order": False})

    def tokens(self, kind: int, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, the chunk of each, where each stops in its chunk, and which chunks come back from their tokens."""
        ids, ends = (self.a, self.b)[kind].many(chunks)
        data, at = buffers(chunks)
        made, after = gather(*self.tables[kind], ids.astype(np.int64))
        bounds = after[ends]
        whole = np.diff(bounds) == np.diff(at)
        chunk = np.repeat(np.arange(len(chunks)), np.diff(ends))
        if len(made) == at[-1] - at[0] and whole.all() and (made == data[at[0] : at[-1]]).all():
            pass
        else:
            for i in np.flatnonzero(whole).tolist():
                whole[i] = (made[bounds[i] : bounds[i + 1]] == data[at[i] : at[i + 1]]).all()
        return ids, chunk, after[1:] - bounds[:-1][chunk], whole

    def groups(self, chunks: pa.Array) -> np.ndarray:
        """Fills DuckDB's tables with the chunks' groups and pairs; gives which chunks come back from both sides' tokens."""
        _, at = buffers(chunks)
        found = [self.tokens(kind, chunks) for kind in (0, 1)]
        good = found[0][3] & found[1][3]
        for name, (ids, chunk, stop, _) in zip(("tokens_a", "tokens_b"), found, strict=True):
            keep = good[chunk]
            stop = (stop + at[:-1][chunk])[keep]
            chunk, ids = chunk[keep], ids[keep]
            start = np.concatenate([np.zeros(1, np.int64), stop])[:-1]
            first = np.flatnonzero(np.diff(chunk, prepend=-1))
            start[first] = at[:-1][chunk[first]]
            self.db.register(name, pa.table({"chunk": chunk.astype(np.int32), "id": ids.astype(np.int32), "start": start, "stop": stop}))
        self.db.execute(GROUPS_SQL)
        self.db.execute(PAIRS_SQL)
        self.db.execute("DROP TABLE a; DROP TABLE b; DROP TABLE links")
        self.db.unregister("tokens_a")
        self.db.unregister("tokens_b")
        return good

    def ordered(self, name: str) -> dict[str, np.ndarray]:
        return self.db.execute(f"SELECT chunk, id, g FROM {name} ORDER BY start").fetchnumpy()


def gather_table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    return np.frombuffer(b"".join(parts), np.uint8), ends


def group_texts(a: dict[str, np.ndarray], b: dict[str, np.ndarray], n_chunks: int) -> list[bytes]:
    """Each chunk's groups as `a1,a2|b1;`, one after the other."""
    top = int(max(a["id"].max(initial=0), b["id"].max(initial=0))) + 1
    names = [str(i).encode() for i in range(top)]
    table = gather_table([x + s for s in (b",", b"|", b";") for x in names])
    last = [np.diff(x["g"], append=-1) != 0 for x in (a, b)]
    symbols = np.concatenate([a["id"] + np.where(last[0], top, 0), b["id"] + np.where(last[1], 2 * top, 0)])
    order = np.argsort(np.concatenate([a["g"].astype(np.int64) * 2, b["g"].astype(np.int64) * 2 + 1]), kind="stable")
    text, after = gather(*table, symbols[order].astype(np.int64))
    sizes = np.bincount(a["chunk"], minlength=n_chunks) + np.bincount(b["chunk"], minlength=n_chunks)
    ends = after[np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])].tolist()
    text = text.tobytes()
    return [text[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]


def align_shard(aligner: Aligner, shard: int, doc_ids: list, held: list) -> pa.RecordBatch:
    """One shard's row; held: (chunks, codes, bounds) of its slices."""
    one = pa.chunked_array([pa.DictionaryArray.from_arrays(c, d) for d, c, _ in held]).unify_dictionaries()
    chunks = one.chunk(0).dictionary
    codes = np.concatenate([c.indices.to_numpy() for c in one.chunks]).astype(np.int64)
    per_doc = np.concatenate([np.diff(b) for _, _, b in held])
    good = aligner.groups(chunks)
    doc_of = np.repeat(np.arange(len(doc_ids)), per_doc)
    void = np.zeros(len(doc_ids), bool)
    void[doc_of[~good[codes]]] = True
    per_doc[void], codes, doc_of = 0, codes[~void[doc_of]], doc_of[~void[doc_of]]
    a, b = aligner.ordered("a_groups"), aligner.ordered("b_groups")
    texts = group_texts(a, b, len(chunks))
    bounds, listed = np.concatenate([np.zeros(1, np.int64), np.cumsum(per_doc)]).tolist(), codes.tolist()
    digests = [hashlib.sha256(b"".join([texts[c] for c in listed[i:j]])[:-1]).hexdigest() if j > i else "" for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    del texts, listed
    stats = aligner.db.execute(PER_CHUNK_SQL).fetchnumpy()
    sums = {}
    for name in _PER_DOC:
        each = np.zeros(len(chunks), np.int64)
        each[stats["chunk"]] = stats[name]
        sums[name] = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(each[codes])])[bounds])
    keys, times = np.unique(doc_of * len(chunks) + codes, return_counts=True)
    doc, chunk = np.divmod(keys, max(1, len(chunks)))
    pairs = aligner.db.execute("SELECT a, b FROM pairs ORDER BY pair").fetchnumpy()
    in_docs = np.zeros(len(pairs["a"]), np.int64)
    edges = np.searchsorted(doc, np.arange(0, len(doc_ids) + DOC_BLOCK, DOC_BLOCK))
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        aligner.db.register("doc_chunks", pa.table({"doc": doc[i:j].astype(np.int32), "chunk": chunk[i:j].astype(np.int32)}))
        part = aligner.db.execute(PARTIAL_SQL).fetchnumpy()
        in_docs[part["pair"]] += part["in_docs"]
    linked = aligner.db.execute("SELECT chunk, pair, n FROM chunk_pairs ORDER BY chunk, pair").fetchnumpy()
    aligner.db.execute("DROP TABLE a_groups; DROP TABLE b_groups; DROP TABLE spans; DROP TABLE pairs; DROP TABLE chunk_pairs")
    docs = pa.StructArray.from_arrays([pa.array(doc_ids, pa.int64()), *[pa.array(sums[n]) for n in _PER_DOC], pa.array(digests, pa.string())], ["doc_id", *_PER_DOC, "groups_sha256"])
    row = {
        "shard": pa.array([shard], pa.int64()), "docs": pa.ListArray.from_arrays([0, len(docs)], docs),
        "doc_ends": np.searchsorted(doc, np.arange(1, len(doc_ids) + 1)), "chunks": chunk, "times": times,
        "chunk_ends": np.searchsorted(linked["chunk"], np.arange(1, len(chunks) + 1)), "pairs": linked["pair"], "links": linked["n"],
        **{k: pa.ListArray.from_arrays([0, len(v)], pa.array(v.astype(np.int32))) for k, v in (("a", pairs["a"]), ("b", pairs["b"]), ("in_docs", in_docs))},
    }
    return pa.record_batch({k: pa.array([_packed(v)], pa.binary()) if isinstance(v, np.ndarray) else v for k, v in row.items()})


def shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Aligned shards of about `shard_bytes` of text, or one longer document, with their partial pair counts."""

    def run(batches):
        aligner, number, doc_ids, held, size = Aligner(), 0, [], [], 0
        for batch in batches:
            texts = pc.cast(batch.column(batch.schema.get_field_index("text")), pa.large_string()).fill_null("")
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            ends = np.cumsum(pc.binary_length(texts).to_numpy())
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + min(SLICE_BYTES, shard_bytes), "right")))
                part = texts.slice(i, j - i)
                lead = pc.if_else(pc.equal(pc.binary_length(part), 0), pa.scalar("", pa.large_string()), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), part, pa.scalar(" ", pa.large_string())))
                held.append(split(lead))
                doc_ids += ids.slice(i, j - i).to_pylist()
                size += int(ends[j - 1] - (ends[i - 1] if i else 0))
                if size >= shard_bytes:
                    yield align_shard(aligner, TaskContext.get().partitionId() << 32 | number, doc_ids, held)
                    doc_ids, held, size, number = [], [], 0, number + 1
                    give_back()
                i = j
        if doc_ids:
            yield align_shard(aligner, TaskContext.get().partitionId() << 32 | number, doc_ids, held)
        aligner.db.close()
        give_back()

    return own_columns(docs, "doc_id", "text").mapInArrow(run, _SHARD)


def _sums(shard: pa.Table, known: pa.Table) -> pa.Table:
    """Each document's links with the highest count of their A id, and the sum of its links' counts."""
    get = lambda name: _unpacked(shard[name][0].as_py())
    pairs, links, chunk_ends = get("pairs"), get("links"), get("chunk_ends")
    k, size = known["k"].to_numpy(), int(pairs.max(initial=-1)) + 1  # pairs of void documents alone have no count
    count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    count[k], best[k] = known["n"].to_numpy(), known["best"].to_numpy()
    total = lambda values, ends: np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])[np.concatenate([np.zeros(1, np.int64), ends])])
    chunks, times, doc_ends = get("chunks"), get("times"), get("doc_ends")
    docs = shard["docs"].combine_chunks().flatten()
    columns = {name: docs.field(name) for name in ("doc_id", *_PER_DOC, "groups_sha256")}
    for name, values in (("n_best", best), ("count_sum", count)):
        per_chunk = total(links * values[pairs], chunk_ends)
        columns[name] = pa.array(total(times * per_chunk[chunks], doc_ends))
    return pa.table(columns)


def alignment(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Per document doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum; and (a, b, n) of all linked id pairs."""
    held = save(shards(docs, shard_bytes), "aligned-shards")
    partial = held.select("shard", F.posexplode(F.arrays_zip("a", "b", "in_docs")).alias("k", "x")).select("shard", "k", "x.a", "x.b", "x.in_docs").where("in_docs > 0")
    counts = save(partial.groupBy("a", "b").agg(F.sum("in_docs").alias("n")), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("top"))
    judged = counts.join(highest, "a").select("a", "b", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))
    known = partial.select(F.col("shard").alias("of"), "k", "a", "b").join(judged, ["a", "b"]).select("of", "k", "n", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return held.groupBy("shard").cogroup(known.groupBy("of")).applyInArrow(_sums, schema), counts


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *_PER_DOC, "n_best", "count_sum", "groups_sha256")
