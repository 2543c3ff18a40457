"""The k most similar vectors of every vector: inverted file, product-quantised residuals, exact reranking.

Fit (on a sample bounded per centroid): coarse centroids, as many as one per ``LIST_ROWS`` vectors, and one codebook per
sub-space for what is left after the centroid. Index (every row): a vector goes to the list of its nearest
centroid with its residual's code and the length of the code's error, and visits as a query the lists whose
centroids are nearly as near. Search: per list, tables of each query against the codebooks give, by the
members' codes, an asymmetric estimate of every similarity; as the error's length bounds how far an estimate
can be off, every pair that may reach the threshold, and hardly another, is recomputed exactly in double
precision. What a list finds counts for both sides of a pair. So accuracy is lost only where neither of two
vectors visits the other's list.

A batch's exact copies travel as one row. Vectors that recur all over the data, as the sample shows (HOT_ROWS copies or more by its count), are taken out
before the routing: the k + 1 smallest ids of each are searched, and all its copies get what these found. So a group of copies that holds
a third of all rows is neither shuffled with its vectors nor piled up in a list. A list that outgrows its task, by the sample's count, is split into blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.storage import cut, spread

#: Rows a list should hold, and distinct vectors above which one is split into blocks.
LIST_ROWS, BLOCK_ROWS = 2000, 8192
#: The fit reads about this many vectors per centroid; no more centroids than MAX_LISTS are broadcast (32 MB at 64 values). A sample
#: of up to DRIVER_SAMPLE vectors is fitted on the driver, a larger one by the executors, by the same rounds.
SAMPLE_PER_LIST, MAX_LISTS, DRIVER_SAMPLE = 96, 131_072, 262_144
#: Copies above which a vector counts as hot, by a sample that holds at least HOT_SEEN of them; at most MAX_HOT of the most frequent, the others collapse by batch.
HOT_ROWS, HOT_SEEN, MAX_HOT = 1000, 3, 1024
#: Rounds of the centroids' and the codebooks' fit, and residuals the codebooks are fitted to.
ROUNDS, BOOK_ROUNDS, BOOK_SAMPLE = 8, 5, 16_384
#: A vector visits the lists whose centroid is at most PROBE_MARGIN less similar than its nearest, MAX_PROBES at most. Of two indexed
#: vectors either may visit the other's list; a pure query must come itself, so it goes further.
PROBE_MARGIN, MAX_PROBES = 0.07, 12
QUERY_MARGIN, QUERY_PROBES = 0.1, 12
SUBSPACES, CODEWORDS = 16, 256
#: Centroids stand in groups, about as many as a group has centroids; a vector looks at those of the GROUPS nearest groups.
GROUPS = 16
#: Entries of a matrix of similarities to centroids held at once, and cells (blocks of lists) that a task of the search gets.
_MATRIX, CELLS_PER_TASK = 1 << 22, 12
#: Queries scored at once: few enough that a list's estimates stay in the processor's cache.
_QUERY_BLOCK = 64

_ROW = pa.schema([("list", pa.int32()), ("block", pa.int32()), ("role", pa.int8()), ("lead", pa.int64()), ("ids", pa.list_(pa.int64())), ("v", pa.binary()), ("code", pa.binary()), ("err", pa.float32())])
_ROW_DDL = "list int, block int, role byte, lead bigint, ids array<bigint>, v binary, code binary, err float"
MEMBER, VISITOR, QUERY = 0, 1, 2


def valid_vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and float32 vectors of a batch's rows that have an id and ``dim`` finite values, not all zero."""
    ids, vectors = batch.column(0), batch.column(1)
    if not len(vectors):
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    size = np.asarray(vectors.value_lengths().fill_null(-1))
    keep = pa.array((size == dim) & ~np.asarray(ids.is_null()))
    ids, vectors = ids.filter(keep), vectors.filter(keep)
    flat = vectors.flatten().cast(pa.float32())
    x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
    ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return np.asarray(ids)[ok].astype(np.int64), np.ascontiguousarray(x[ok], dtype=np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        bias = 0 if spherical else (c * c).sum(1) / 2
        a = np.concatenate([(x[i : i + 8192] @ c.T - bias).argmax(1) for i in range(0, len(x), 8192)])
        n = np.bincount(a, minlength=k)
        o = np.argsort(a, kind="stable")
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = n > 0
        c[full] = np.add.reduceat(x[o], at[full], axis=0) / n[full][:, None]
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass(frozen=True)
class Quantiser:
    """Coarse centroids in the order of their groups, codebooks (sub-space, word, part), the blocks of each list, the groups' centres and where each begins."""

    centroids: np.ndarray
    books: np.ndarray
    blocks: np.ndarray
    centres: np.ndarray
    begins: np.ndarray
    hot: tuple[bytes, ...] = ()

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def nearest(self, x: np.ndarray, probes: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
        """Lists of each vector, the nearest first, and which of them it visits.

        Two levels: the groups' centres first, then the centroids of the nearest groups, so the work per vector grows with the root of the
        number of lists. Rows are taken in blocks, so that what is held does not grow with it either.
        """
        size = np.diff(self.begins)
        g, widest = min(GROUPS, len(size)), int(size.max())
        step = max(16, _MATRIX // max(len(size), g * widest))
        p = min(probes, int(np.sort(size)[:g].sum()))
        at, top = np.empty((len(x), p), np.int64), np.empty((len(x), p), np.float32)
        for i in range(0, len(x), step):
            part = x[i : i + step]
            s = part @ self.centres.T
            near = np.argpartition(-s, g - 1, axis=1)[:, :g] if g < len(size) else np.tile(np.arange(g), (len(part), 1))
            some = np.full((len(part), g * widest), -np.inf, np.float32)
            order = np.argsort(near, axis=None, kind="stable")
            row, slot = order // g, order % g
            cuts = np.searchsorted(near.ravel()[order], np.arange(len(size) + 1))
            for j in np.nonzero(np.diff(cuts))[0]:
                r, k = row[cuts[j] : cuts[j + 1]], slot[cuts[j] : cuts[j + 1]]
                found = part[r] @ self.centroids[self.begins[j] : self.begins[j + 1]].T
                some[r[:, None], (k * widest)[:, None] + np.arange(size[j])] = found
            best = np.argpartition(-some, p - 1, axis=1)[:, :p] if p < some.shape[1] else np.tile(np.arange(p), (len(part), 1))
            value = np.take_along_axis(some, best, 1)
            o = np.argsort(-value, axis=1, kind="stable")
            best, top[i : i + step] = np.take_along_axis(best, o, 1), np.take_along_axis(value, o, 1)
            at[i : i + step] = self.begins[np.take_along_axis(near, best // widest, 1)] + best % widest
        return at, top >= top[:, :1] - margin

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the lengths of their errors."""
        r = x - self.centroids[lists]
        m, _, w = self.books.shape
        codes, err = np.empty((len(x), m), np.uint8), np.zeros(len(x), np.float32)
        for j in range(m):
            part, book = r[:, j * w : (j + 1) * w], self.books[j]
            codes[:, j] = (part @ book.T - (book * book).sum(1) / 2).argmax(1)
            d = part - book[codes[:, j]]
            err += np.einsum("ij,ij->i", d, d)
        return codes, np.sqrt(err)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(sub-space, word, query): each query's product with each codeword."""
        m, k, w = self.books.shape
        return np.stack([self.books[j] @ q[:, j * w : (j + 1) * w].T for j in range(m)])


def fit(vectors: DataFrame, dim: int, seed: int = 7) -> Quantiser | None:
    """A quantiser for (id, vector), from a sample by a hash of the id; None without a valid vector.

    The driver sees the centroids, DRIVER_SAMPLE vectors at most, and counts per list.
    """
    rows = vectors.count()
    lists = int(np.clip(rows // LIST_ROWS, 1, MAX_LISTS))
    want = max(4096, SAMPLE_PER_LIST * lists)
    share = min(1.0, want / max(1, rows))
    id_col = vectors.columns[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = valid_vectors(b, dim)
            yield pa.record_batch([pa.array([v.tobytes() for v in x], pa.binary())], names=["v"])

    some = vectors.where(F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    sample = some.mapInArrow(read, "v binary")
    if want > DRIVER_SAMPLE:
        counted = cut(sample.groupBy("v").count())
        often = counted.where(F.col("count") >= max(HOT_SEEN, share * HOT_ROWS)).orderBy(F.desc("count"), "v").limit(MAX_HOT)
        far = _train_far(counted.select("v"), dim, lists, share, seed)
        return far and replace(far, hot=tuple(bytes(r.v) for r in often.collect()))
    seen = sample.toPandas()["v"].value_counts(sort=False)
    raw, often = seen.index.to_numpy(), seen[seen >= max(HOT_SEEN, share * HOT_ROWS)].sort_index().sort_values(ascending=False, kind="stable")
    if not len(raw) and rows and share < 1:  # no valid vector in the sample: any that there are
        raw, share = vectors.mapInArrow(read, "v binary").limit(4096).toPandas()["v"].unique(), 1.0
    return replace(_train(raw, dim, lists, len(raw) / share, seed), hot=tuple(map(bytes, often.index[:MAX_HOT]))) if len(raw) else None


def hot_ids(vectors: DataFrame, dim: int, quantiser) -> DataFrame:
    """(hot, id): the rows of hot vectors, by their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {v: i for i, v in enumerate(quantiser.value.hot)}
        for b in batches:
            ids, x = valid_vectors(b, dim)
            at = np.array([number.get(v.tobytes(), -1) for v in x], np.int32)
            yield pa.record_batch([pa.array(at[at >= 0], pa.int32()), pa.array(ids[at >= 0], pa.int64())], names=["hot", "id"])

    return vectors.mapInArrow(run, "hot int, id bigint")


@dataclass(frozen=True)
class Hot:
    """Hot vectors' copies (lead, id), each once, and their leaders (lead), at most MAX_HOT."""

    copies: DataFrame
    leads: DataFrame


def hot_rows(vectors: DataFrame, dim: int, quantiser, visits: bool, copies: int) -> tuple[DataFrame, Hot]:
    """Index rows of each hot vector's ``copies`` smallest ids, as one row that leads them, and all its copies."""

    def least(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, list[int]] = {}
        for f in frames:
            for h, g in f.groupby("hot")["id"]:
                best[h] = sorted({*best.get(h, []), *np.unique(g)[:copies].tolist()})[:copies]
        yield pd.DataFrame([(h, i) for h, x in best.items() for i in x], columns=["hot", "id"])

    spark, hot = vectors.sparkSession, quantiser.value.hot
    ids = hot_ids(vectors, dim, quantiser)
    # a task hands on a few ids per vector, so the driver sees MAX_HOT times ``copies``
    few = ids.mapInPandas(least, "hot int, id bigint").groupBy("hot").agg(F.slice(F.array_sort(F.array_distinct(F.collect_list("id"))), 1, copies).alias("ids")).orderBy("hot").collect()
    batch = pa.record_batch(
        [
            pa.array([i for r in few for i in r.ids], pa.int64()),
            pa.array([np.frombuffer(hot[r.hot], np.float32) for r in few for _ in r.ids], pa.list_(pa.float32())),
        ],
        names=["id", "v"],
    )
    rows = spark.createDataFrame(pa.Table.from_batches(list(_route(quantiser, dim, False, visits, copies, False)(iter([batch]))), _ROW), _ROW_DDL)
    leads = spark.createDataFrame([(r.hot, r.ids[0]) for r in few], "hot int, lead bigint")
    return rows, Hot(ids.distinct().join(F.broadcast(leads), "hot").select("lead", "id"), leads.select("lead"))


def _floats(raw: np.ndarray, dim: int) -> np.ndarray:
    return unit(np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim)).astype(np.float32)


def _finish(c: np.ndarray, x: np.ndarray, share: np.ndarray, distinct: float, rng: np.random.Generator) -> Quantiser:
    """Codebooks from the residuals of ``x``, and blocks from each list's share of the distinct vectors."""
    x = x[rng.permutation(len(x))[:BOOK_SAMPLE]]
    r = x - c[_nearest(x, c)]
    dim = c.shape[1]
    m = max(d for d in range(1, SUBSPACES + 1) if dim % d == 0)
    w = dim // m
    books = np.stack([_kmeans(np.ascontiguousarray(r[:, j * w : (j + 1) * w]), CODEWORDS, BOOK_ROUNDS, rng, False) for j in range(m)])
    groups = max(1, round(len(c) ** 0.5))
    centres = _kmeans(c, groups, ROUNDS, rng, True)
    home = _nearest(c, centres)
    order, size = np.argsort(home, kind="stable"), np.bincount(home, minlength=groups)
    blocks = np.maximum(1, np.ceil(share[order] * distinct / BLOCK_ROWS)).astype(np.int32)
    return Quantiser(c[order], books, blocks, centres[size > 0], np.r_[0, np.cumsum(size[size > 0])])


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 23) // len(c))
    return np.concatenate([(x[i : i + step] @ c.T).argmax(1) for i in range(0, len(x), step)])


def _train(raw: np.ndarray, dim: int, lists: int, distinct: float, seed: int) -> Quantiser:
    rng = np.random.default_rng(seed)
    x = _floats(np.sort(raw), dim)
    c = _kmeans(x, min(lists, len(x)), ROUNDS, rng, True)
    return _finish(c, x, np.bincount(_nearest(x, c), minlength=len(c)) / len(x), distinct, rng)


def _train_far(sample: DataFrame, dim: int, lists: int, share: float, seed: int) -> Quantiser | None:
    """The same rounds on the executors: each adds up its part's vectors per centroid, and the sums meet per centroid."""
    sc = sample.sparkSession.sparkContext
    n = sample.count()
    if not n:
        return None
    some = lambda k: _floats(np.sort(sample.orderBy(F.xxhash64("v", F.lit(seed))).limit(k).toPandas()["v"].to_numpy()), dim)
    c = some(min(lists, n))

    def add(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = shared.value
            total, count = np.zeros(now.shape, np.float32), np.zeros(len(now), np.int64)
            for b in batches:
                if len(b):
                    x = _floats(np.array(b.column(0).to_pylist(), object), dim)
                    at = _nearest(x, now)
                    np.add.at(total, at, x)
                    count += np.bincount(at, minlength=len(now))
            has = np.nonzero(count)[0]
            yield pa.record_batch([pa.array(has, pa.int64()), pa.array(count[has], pa.int64()), pa.array([total[i].tobytes() for i in has], pa.binary())], names=["list", "n", "s"])

        return run

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(b"".join(f["s"]), np.float32).reshape(-1, dim).sum(axis=0, dtype=np.float32)
        return pd.DataFrame({"list": f["list"].iloc[:1], "n": [f["n"].sum()], "s": [total.tobytes()]})

    counts = np.zeros(len(c), np.int64)
    for _ in range(ROUNDS):
        parts = sample.mapInArrow(add(sc.broadcast(c)), "list bigint, n bigint, s binary")
        got = parts.groupBy("list").applyInPandas(merge, "list bigint, n bigint, s binary").toPandas()
        at, counts = got["list"].to_numpy(), np.zeros(len(c), np.int64)
        counts[at] = got["n"]
        # a centroid that none chose stays where it is
        total = np.frombuffer(b"".join(got["s"]), np.float32).reshape(-1, dim)
        c = c.copy()
        c[at] = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return _finish(c, some(BOOK_SAMPLE), counts / n, n / share, np.random.default_rng(seed))


def _route(quantiser, dim: int, query_only: bool, visits: bool, copies: int, skip_hot: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qz: Quantiser = quantiser.value
        hot = frozenset(qz.hot) if skip_hot else ()
        for batch in batches:
            ids, raw = valid_vectors(batch, dim)
            if hot:
                cold = np.array([v.tobytes() not in hot for v in raw], bool)
                ids, raw = ids[cold], raw[cold]
            if not len(ids):
                continue
            # exact copies in a batch become one row that leads them; ids ascend, so a leader is its copies' smallest
            o = np.argsort(ids, kind="stable")
            ids, raw = ids[o], raw[o]
            if query_only:
                first, group = np.arange(len(ids)), np.arange(len(ids))
            else:
                _, first, group = np.unique(np.ascontiguousarray(raw).view(f"V{4 * dim}").ravel(), return_index=True, return_inverse=True)
            gathered = np.split(ids[np.argsort(group, kind="stable")], np.cumsum(np.bincount(group))[:-1])
            gathered = [np.unique(g) for g in gathered]
            raw, lead = raw[first], ids[first]
            x = unit(raw).astype(np.float32)
            lists, go = qz.nearest(x, QUERY_PROBES, QUERY_MARGIN) if query_only else qz.nearest(x, MAX_PROBES, PROBE_MARGIN)
            if not visits:
                go[:, 1:] = False
            codes, err = qz.encode(x, lists[:, 0]) if not query_only else (np.zeros((len(x), 1), np.uint8), np.zeros(len(x), np.float32))
            who, nth = np.nonzero(go)
            at = lists[who, nth]
            n = qz.blocks[at]
            who, nth, at = np.repeat(who, n), np.repeat(nth, n), np.repeat(at, n)
            block = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            home = (nth == 0) & (block == lead[who] % qz.blocks[at]) & (not query_only)
            role = np.where(home, MEMBER, QUERY if query_only else VISITOR)
            for i in range(0, len(who), 8192):
                s = slice(i, i + 8192)
                w, h = who[s], home[s]
                yield pa.record_batch(
                    [
                        pa.array(at[s], pa.int32()), pa.array(block[s], pa.int32()), pa.array(role[s], pa.int8()), pa.array(lead[w], pa.int64()),
                        pa.array([gathered[j] if m else gathered[j][1:copies] for j, m in zip(w, h, strict=True)], pa.list_(pa.int64())),
                        pa.array([raw[j].tobytes() for j in w], pa.binary()),
                        pa.array([codes[j].tobytes() if m else b"" for j, m in zip(w, h, strict=True)], pa.binary()),
                        pa.array(np.where(h, err[w], np.float32(0)), pa.float32()),
                    ],
                    schema=_ROW,
                )

    return run


def build_index(vectors: DataFrame, dim: int, quantiser, visits: bool = True, copies: int = 1) -> tuple[DataFrame, Hot | None]:
    """Every valid vector's rows (``_ROW_DDL``) in its list and in the lists it visits; a visitor brings the ids of ``copies`` of its equals, itself included.

    Of hot vectors only ``copies`` ids are there; ``Hot`` has all of them, None where nothing is hot.
    """
    rows = vectors.mapInArrow(_route(quantiser, dim, False, visits, copies, True), _ROW_DDL)
    if not quantiser.value.hot:
        return rows, None
    few, hot = hot_rows(vectors, dim, quantiser, visits, copies)
    return rows.unionByName(few), hot


def build_queries(vectors: DataFrame, dim: int, quantiser) -> DataFrame:
    """Rows that search the lists, but are not found themselves."""
    return vectors.mapInArrow(_route(quantiser, dim, True, True, 1, False), _ROW_DDL)


@dataclass
class Cell:
    """One list's block: its distinct members first, then visitors, then queries; all unit vectors."""

    lead: np.ndarray
    role: np.ndarray
    ids: list[np.ndarray]
    x: np.ndarray
    members: int


def read_cell(rows: pd.DataFrame, dim: int) -> tuple[Cell, np.ndarray, np.ndarray]:
    """The cell, its members' codes and errors; rows come sorted by role and lead."""
    member = (rows["role"] == MEMBER).to_numpy()
    raw = np.frombuffer(b"".join(rows["v"]), np.float32).reshape(-1, dim)
    codes = np.frombuffer(b"".join(rows["code"][member]), np.uint8).reshape(int(member.sum()), -1)
    lead = rows["lead"].to_numpy()
    # a member lists all its ids, others those that follow their leader
    ids = [np.asarray(i, np.int64) if m else np.r_[a, np.asarray(i, np.int64)] for a, i, m in zip(lead, rows["ids"], member, strict=True)]
    cell = Cell(lead, rows["role"].to_numpy(), ids, unit(raw), int(member.sum()))
    return cell, codes, rows["err"].to_numpy()[member]


def similar_pairs(cell: Cell, codes: np.ndarray, err: np.ndarray, qz: Quantiser, at: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, member, similarity rounded to 6 decimals) of each pair of a row and another member of at least ``threshold``.

    Estimates come from the tables; the exact product is taken of pairs whose estimate plus error bound may reach it.
    """
    m = cell.members
    x = cell.x.astype(np.float32)
    base = x @ qz.centroids[at]
    least = (threshold - 1e-5 - err).astype(np.float32)[:, None]
    words = [codes[:, j].astype(np.intp) for j in range(codes.shape[1])]
    for i in range(0, len(x), _QUERY_BLOCK):
        q = x[i : i + _QUERY_BLOCK]
        tables = qz.tables(q)
        estimate = np.repeat(base[None, i : i + _QUERY_BLOCK], m, axis=0)
        part = np.empty_like(estimate)
        for table, word in zip(tables, words, strict=True):
            np.take(table, word, axis=0, out=part, mode="clip")
            estimate += part
        y, row = np.nonzero(estimate >= least)
        row = row + i
        other = row != y
        row, y = row[other], y[other]
        for k in range(0, len(row), 1 << 16):
            a, b = row[k : k + (1 << 16)], y[k : k + (1 << 16)]
            s = np.round(np.einsum("ij,ij->i", cell.x[a], cell.x[b]), 6)
            ok = s >= threshold
            yield a[ok], b[ok], s[ok]


def scan_cells(index: DataFrame, dim: int, quantiser, threshold: float, reduce: Callable, ddl: str) -> DataFrame:
    """``reduce(cell, row, member, similarity)`` of every list's block, as rows of ``ddl``."""
    from tidemark.operators.intervals import whole_groups

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qz: Quantiser = quantiser.value
        for f in whole_groups(frames, ["list", "block"]):
            for (at, _), rows in f.groupby(["list", "block"], sort=False):
                cell, codes, err = read_cell(rows, dim)
                found = list(similar_pairs(cell, codes, err, qz, int(at), threshold)) if cell.members else []
                row, member, s = (np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                out = reduce(cell, row, member, s)
                if len(out):
                    yield out

    # as many tasks as the cells need, whatever the session's partitions are
    conf = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(conf, -(-int(quantiser.value.blocks.sum()) // CELLS_PER_TASK))
    sorted_ = index.repartition(tasks, "list", "block").sortWithinPartitions("list", "block", "role", "lead")
    return sorted_.mapInPandas(run, ddl)


def _best(owner: np.ndarray, sim: np.ndarray, cand: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's k best distinct candidates by similarity, then smaller candidate."""
    o = np.lexsort((cand, -sim, owner))
    if len(o):  # copies of one row in several batches are one candidate
        o = o[np.r_[True, (owner[o[1:]] != owner[o[:-1]]) | (cand[o[1:]] != cand[o[:-1]])]]
    own = owner[o]
    start = np.r_[True, own[1:] != own[:-1]]
    rank = np.arange(len(o)) - np.nonzero(start)[0][np.cumsum(start) - 1]
    return o[rank < k]


_FOUND_DDL = "query boolean, lead bigint, ids array<bigint>, cand array<bigint>, micro array<int>"


def _top(k: int):
    def reduce(cell: Cell, row: np.ndarray, member: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        # both sides of a pair gain; the copies a row leads are candidates of their own, also to each other
        back = cell.role[row] == VISITOR
        multi = [i for i in range(len(cell.ids)) if len(cell.ids[i]) > 1 and cell.role[i] == MEMBER]
        owner = np.concatenate([row, member[back], np.array(multi, np.int64)])
        other = np.concatenate([member, row[back], np.array(multi, np.int64)])
        sim = np.concatenate([s, s[back], np.ones(len(multi))])
        count = np.array([min(len(i), k + 1) for i in cell.ids], np.int64)
        flat = np.concatenate([i[: k + 1] for i in cell.ids]) if len(cell.ids) else np.zeros(0, np.int64)
        at = np.cumsum(count) - count
        n = count[other]
        owner, sim = np.repeat(owner, n), np.repeat(sim, n)
        cand = flat[np.repeat(at[other], n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)]
        keep = _best(owner, sim, cand, k + 1)
        owner, sim, cand = owner[keep], sim[keep], cand[keep]
        if not len(owner):
            return pd.DataFrame()
        cut = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
        who = owner[cut]
        return pd.DataFrame({
            "query": cell.role[who] == QUERY, "lead": cell.lead[who],
            "ids": [cell.ids[w] if cell.role[w] == MEMBER else cell.ids[w][:0] for w in who],
            "cand": np.split(cand, cut[1:]), "micro": np.split(np.rint(sim * 1e6).astype(np.int32), cut[1:]),
        })

    return reduce


def nearest_vectors(base: DataFrame, queries: DataFrame | None, base_id: str, base_vector: str, query_id: str | None = None, query_vector: str | None = None, k: int = 5, threshold: float = 0.85, dim: int = 64) -> DataFrame:
    """(query boolean, id, neighbour, rank, similarity): up to k nearest base vectors of every valid base vector (``query`` false)
    and every valid query vector (true), by cosine rounded to 6 decimals, then smaller id; at least ``threshold`` similar.

    A null, short, long, not finite or all-zero vector neither searches nor is found, nor is a row without
    id. Ids must be distinct but for exact copies of a row, which count once. Vectors that are equal, or
    multiples of one another, are neighbours of similarity 1. Empty tables give no rows.
    """
    spark = base.sparkSession
    b = base.select(F.col(base_id).cast("bigint").alias("id"), F.col(base_vector).alias("v"))
    qz = fit(b, dim)
    out = "query boolean, id bigint, neighbour bigint, rank int, similarity double"
    if qz is None:
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(qz)
    index, hot = build_index(spread(b, "id"), dim, shared, copies=k + 1)
    if queries is not None:
        index = index.unionByName(build_queries(spread(queries.select(F.col(query_id).cast("bigint").alias("id"), F.col(query_vector).alias("v")), "id"), dim, shared))
    found = scan_cells(index, dim, shared, threshold, _top(k), _FOUND_DDL)
    # per leader: what its own list and the lists it visited found, and who its copies are
    pairs = F.flatten(F.collect_list(F.transform(F.arrays_zip("micro", "cand"), lambda x: F.struct((-x.micro).alias("s"), x.cand.alias("c")))))
    lead = found.groupBy("query", "lead").agg(F.array_sort(F.array_distinct(pairs)).alias("best"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    own = lead
    if hot is not None:
        own = lead.where("query").unionByName(lead.where("not query").join(F.broadcast(hot.leads), "lead", "left_anti"))
    each = own.select("query", F.explode(F.array_distinct(F.concat(F.array("lead"), "ids"))).alias("id"), F.slice("best", 1, k + 1).alias("best"))
    if hot is not None:
        # all copies of a hot vector get what its leader found, each without itself; leaders are at most MAX_HOT
        tops = lead.where("not query").join(F.broadcast(hot.leads), "lead", "left_semi").select("lead", F.slice("best", 1, k + 1).alias("best"))
        each = each.unionByName(hot.copies.join(F.broadcast(tops), "lead").select(F.lit(False).alias("query"), "id", "best"))
    mine = F.slice(F.filter("best", lambda x: F.col("query") | (x.c != F.col("id"))), 1, k)
    return each.select("query", "id", F.posexplode(mine).alias("rank", "n")).select("query", "id", F.col("n.c").alias("neighbour"), (F.col("rank") + 1).alias("rank"), (-F.col("n.s") / 1e6).alias("similarity"))
