"""SimHash near-duplicates by tiled exact comparison.

Fingerprint: texts with A-Z lower-cased, words between ASCII white space, word
shingles joined by a space and hashed with XXH64; a bit is set if more than
half of the shingle hashes have it.

Distinct fingerprints lie in tiles of equal population counts, counted apart
for each of the four 16-bit quarters. Two fingerprints within ``radius`` bits
differ by no more than ``radius`` in the sum of the count differences, so only
such tile pairs are compared, by exclusive-or and bit counts in numpy. A pair
of tiles returns a spanning forest of its links, never all its pairs, and
components of the forests' union give each document its group.

Defined results: null and empty texts have fingerprint zero and link like any
other; copies share a fingerprint and are compared once; a group's id is its
smallest doc_id, nulls ignored; rows that repeat keep one result each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays as A
from .common import fresh, identity, row_key, written
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
ROW = ["did", "k1", "k2"]
TILE = 2_048  # fingerprints of a tile, about
BLOCK = 1 << 19  # comparisons held at once

# The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161,
                                             9650029242287828579, 2870177450012600261))


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each span of ``raw``, all spans at once."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray(shape=(len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    seed, length = np.uint64(seed), (stops - starts).astype(np.uint64)
    at, out = starts.copy(), np.full(len(starts), seed + P5, dtype=np.uint64)

    def rounds(acc, lane):
        return _rotate(acc + lane * P2, 31) * P1

    long = np.flatnonzero(stops - starts >= 32)
    if len(long):
        base = [int(seed) + int(P1) + int(P2), int(seed) + int(P2), int(seed), int(seed) - int(P1)]
        acc = [np.full(len(long), b % (1 << 64), np.uint64) for b in base]
        stripes, pos = (stops[long] - starts[long]) // 32, starts[long].copy()
        for s in range(int(stripes.max())):
            on = np.flatnonzero(stripes > s)
            for j in range(4):
                acc[j][on] = rounds(acc[j][on], lanes[pos[on] + 8 * j])
            pos[on] += 32
        h = _rotate(acc[0], 1) + _rotate(acc[1], 7) + _rotate(acc[2], 12) + _rotate(acc[3], 18)
        for j in range(4):
            h = (h ^ rounds(np.zeros(len(long), np.uint64), acc[j])) * P1 + P4
        out[long], at[long] = h, pos
    out += length
    while True:
        on = np.flatnonzero(stops - at >= 8)
        if not len(on):
            break
        out[on] = _rotate(out[on] ^ rounds(np.zeros(len(on), np.uint64), lanes[at[on]]), 27) * P1 + P4
        at[on] += 8
    on = np.flatnonzero(stops - at >= 4)
    out[on] = _rotate(out[on] ^ ((lanes[at[on]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[on] += 4
    while True:
        on = np.flatnonzero(stops > at)
        if not len(on):
            break
        out[on] = _rotate(out[on] ^ ((lanes[at[on]] & np.uint64(0xFF)) * P5), 11) * P1
        at[on] += 1
    out ^= out >> np.uint64(33)
    out *= P2
    out ^= out >> np.uint64(29)
    out *= P3
    return out ^ (out >> np.uint64(32))


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprint of each text."""
    raw, offsets = A.text_bytes(texts)
    starts, stops, rows = A.spans(raw, offsets, A.SPACES)
    # words one after another, each followed by one space
    ends = np.cumsum(stops - starts + 1)
    begins = ends - (stops - starts + 1)
    clean = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
    inside = ~A.SPACES[raw]
    spaces = np.zeros(len(clean), dtype=bool)
    spaces[ends - 1] = True
    clean[~spaces] = A.LOWER[raw[inside]]
    first = np.searchsorted(rows, np.arange(len(offsets)))
    n_words = first[1:] - first[:-1]
    n_shingles = np.where(n_words > 0, np.maximum(1, n_words - shingle + 1), 0)
    owner = np.repeat(np.arange(len(n_words)), n_shingles)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    word = first[owner] + nth
    last = np.minimum(word + shingle, first[owner + 1]) - 1
    out = np.zeros(len(n_words), dtype=np.uint64)
    if not len(owner):
        return out
    hashes = xxh64(clean, begins[word], ends[last] - 1)
    full = np.flatnonzero(n_shingles)
    cuts = (np.cumsum(n_shingles) - n_shingles)[full]
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for bit, mask in enumerate(bits):
        count = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), cuts)
        out[full] |= np.where(2 * count > n_shingles[full], mask, np.uint64(0))
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(id, did, k1, k2, fp) for each row; did, k1 and k2 tell rows apart, fp is the
    fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in A.chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [*(chunk.column(c) for c in ("id", *ROW)), pa.array(fingerprints(chunk.column("text"), shingle).view(np.int64))],
                names=["id", *ROW, "fp"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), *row_key(docs, id_col, text_col))
    return rows.mapInArrow(run, "id long, did long, k1 long, k2 long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, smallest value of its component) for the values of links a-b."""
    values, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(values))
    return values[other], values[label[other]]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two tiles (the same one twice: within it)."""
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    step = max(1, BLOCK // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at:at + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        x, y = a[at + i], b[j]
        differ = x != y
        if differ.any():
            x, y = _forest(x[differ], y[differ])
            left.append(x)
            right.append(y)
    return _forest(np.concatenate(left), np.concatenate(right))


def _quarter_counts(fp: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int") for i in range(4)]


def _cell(counts: list[Column]) -> Column:
    code = counts[0]
    for c in counts[1:]:
        code = code * 32 + c
    return code.cast("int")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest of the links between the distinct ``fp`` values."""
    counts = _quarter_counts(F.col("fp"))
    placed = fps.select("fp", _cell(counts).alias("cell"))
    crowd = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    # at most 17**4 cells of two ints: a bounded broadcast
    tiles = written(placed.join(F.broadcast(crowd), "cell")
                    .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int").alias("part"))
                    .agg(F.collect_list("fp").alias("fps")), "tiles")
    names = tiles.select("cell", "part")
    shifts = [s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius and s >= (0,) * 4]
    quarters = [F.shiftright(F.col("cell"), 5 * (3 - i)).bitwiseAND(F.lit(31)) for i in range(4)]
    near = F.array(*[F.struct(*[F.lit(x).alias(f"s{i}") for i, x in enumerate(s)]) for s in shifts])
    asked = (names.select("cell", "part", *[q.alias(f"q{i}") for i, q in enumerate(quarters)], F.explode(near).alias("s"))
             .select("cell", "part", *[(F.col(f"q{i}") + F.col(f"s.s{i}")).alias(f"n{i}") for i in range(4)])
             .where(" and ".join(f"n{i} between 0 and 16" for i in range(4)))
             .select("cell", "part", _cell([F.col(f"n{i}") for i in range(4)]).alias("cell2")))
    pairs = asked.join(names.select(F.col("cell").alias("cell2"), F.col("part").alias("part2")), "cell2")
    pairs = pairs.where("cell <> cell2 or part <= part2")
    met = (pairs.join(tiles.withColumnRenamed("fps", "a"), ["cell", "part"])
           .join(tiles.select(F.col("cell").alias("cell2"), F.col("part").alias("part2"), F.col("fps").alias("b")),
                 ["cell2", "part2"]).select("a", "b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("a", "b"):
                column = batch.column(name)
                sides.append((column.flatten().to_numpy(zero_copy_only=False).view(np.uint64),
                              np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])))
            (a, a_at), (b, b_at) = sides
            out = [tile_links(a[a_at[i]:a_at[i + 1]], b[b_at[i]:b_at[i + 1]], radius) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[k] for o in out] or [np.zeros(0, np.uint64)]).view(np.int64)) for k in (0, 1)],
                names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long").distinct()


def groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, did, k1, k2, fp, first) for each row; ``first`` is the place (none, id, did, k1, k2) of its group's first row, null ids last."""
    rows = written(with_fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    place = F.struct(F.col("id").isNull().alias("none"), "id", *ROW)
    values = written(rows.groupBy("fp").agg(F.min(place).alias("low")), "values")
    roots = components(links(values.select("fp"), radius))
    named = values.join(roots, values["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("first"))
    named = named.join(lowest, "root").select("fp", "first")
    return rows.join(named, "fp").select("id", *ROW, "fp", "first")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document."""
    return groups(docs).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                               F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The first document of each group (smallest id, nulls last); of rows that
    repeat its id and text one stays."""
    found = groups(docs, shingle, radius, id_col, text_col)
    is_first = [F.col(c) == F.col(f"first.{c}") for c in ROW]
    kept = found.where(is_first[0] & is_first[1] & is_first[2]).select(*[F.col(c).alias(f"kept_{c}") for c in ROW]).distinct()
    row = [fresh(docs, f"key_{c}") for c in ROW]
    own = docs.withColumns(dict(zip(row, identity(docs[id_col], docs[text_col].cast("string")), strict=True)))
    same = [own[r] == kept[f"kept_{c}"] for r, c in zip(row, ROW, strict=True)]
    held = own.join(kept, same[0] & same[1] & same[2], "left_semi")
    nth = fresh(held, "key_nth")
    order = Window.partitionBy(*row).orderBy(F.col(row[0]))
    return held.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*[f"`{c}`" for c in docs.columns])
