"""Near-duplicates of word shingles by HyperMinHash sketches, banding and verification.

Shingles of a document are hashed once. The first part of a hash names one of
``REGISTERS`` buckets; of the smallest rest in each bucket a register keeps the number of
leading zeros and ``MANTISSA`` further bits. Empty registers borrow from filled ones
chosen by hashing, so short documents have full sketches. ``ROWS`` registers form a band.

Documents with equal shingle sets form one class, and only its smallest id goes on.
Classes that share a band are candidates. To avoid all pairs of a crowded band, its members
first meet one hub, the member with the smallest id; verified links give components,
and then only members outside the hub's component meet the others of their band, in
bounded blocks that carry sketches and shingle sets, and give only the links that join
components. Candidates of at least ``REGISTERS`` shingles first pass a Jaccard estimate from their
registers, corrected for registers that agree by chance; all take the exact test on full shingle sets.

With similarity 0.75 a pair shares no band with probability (1 - 0.75^5)^40 = 2e-5; the
estimate's limit lies five standard deviations below. In short texts buckets collide, so more
pairs share no band: 2e-4 of those of 4 against 3 shingles, 6e-5 of 8 against 6 (measured).

Defined cases: A-Z are lower-cased and words are what stands between ASCII white space;
null texts and texts without words have no shingle and link with nothing; shorter texts are
one shingle; documents of equal id are one node of the graph, and each of their rows
is returned; rows with a null id are returned unlinked with a null component and kept;
repeated rows are repeated; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pareto_frame.llm.common import maybe_broadcast, stored
from pareto_frame.llm.components import components

WORDS = 5
SHARE, OF = 75, 100
REGISTERS, ROWS, MANTISSA = 200, 5, 10
BANDS = REGISTERS // ROWS
#: Five standard deviations of the estimate below the wanted similarity.
ESTIMATE = SHARE / OF - 5 * (SHARE / OF * (1 - SHARE / OF) / REGISTERS) ** 0.5
#: Members of a crowded band that one comparison holds, twice.
BLOCK = 256

U = np.uint64
_MIX = [U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_PLACES = [U(0x9E3779B97F4A7C15 * (2 * i + 1) & (2**64 - 1)) for i in range(WORDS)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * _MIX[0]
    h = (h ^ (h >> U(27))) * _MIX[1]
    return h ^ (h >> U(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    if len(words) < WORDS:
        whole = np.array([len(words)], U)
        for i in range(len(words)):
            whole = mix(whole + h[i : i + 1] * _PLACES[i])
        return whole
    n = len(h) - WORDS + 1
    total = np.zeros(n, U)
    for i in range(WORDS):
        total += mix(h[i : i + n] * _PLACES[i])
    return np.unique(mix(total))


# sketches


def _probes() -> np.ndarray:
    """For each register the order in which it asks the others."""
    rng = np.random.default_rng(5)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


_ASKED = _probes()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a non-empty shingle set: leading zeros << MANTISSA | mantissa."""
    bucket = (hashes >> U(48)) * U(REGISTERS) >> U(16)
    rest = mix(hashes) >> U(1)  # 63 bits
    least = np.full(REGISTERS, U(1 << 63))
    np.minimum.at(least, bucket.astype(np.int64), rest)
    filled = least < U(1 << 63)
    zeros = 62 - np.floor(np.log2(np.maximum(least, U(1)).astype(np.float64))).astype(np.int64).clip(0, 62)
    top = (62 - zeros).astype(U)  # place of the leading one
    below = least - (U(1) << top) * filled.astype(U)
    mantissa = np.where(top >= U(MANTISSA), below >> (np.maximum(top, U(MANTISSA)) - U(MANTISSA)), below)
    registers = (zeros.astype(U) << U(MANTISSA)) | (mantissa & U((1 << MANTISSA) - 1))
    if not filled.all():
        lender = _ASKED[np.arange(REGISTERS), filled[_ASKED].argmax(1)]
        registers = np.where(filled, registers, registers[lender])
    return registers.astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of ``registers``."""
    parts = registers.reshape(len(registers), BANDS, ROWS).astype(U)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key + parts[:, :, i] + U(1))
    return key.view(np.int64)


def estimate(agreeing: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of agreeing registers.

    Two registers of different shingles agree by chance if their leading zeros (each count z with
    probability 2^-(z+1)) and their mantissas are equal: 1/3 * 2^-MANTISSA of the cases. That
    share of the disagreeing ones is taken off again.
    """
    chance = 2.0**-MANTISSA / 3
    return (agreeing / REGISTERS - chance) / (1 - chance)


# tasks


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = shingles(text.as_py())
            if len(s):
                print1 = int(np.bitwise_xor.reduce(s).view(np.int64))
                print2 = int(np.add.reduce(mix(s + U(1))).view(np.int64))
                rows.append((doc_id, len(s), print1, print2, sketch(s).tobytes()))
            else:
                rows.append((doc_id, 0, 0, 0, b""))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "n", "print1", "print2", "registers"]
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        registers = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16)
        keys = band_keys(registers.reshape(-1, REGISTERS))
        ids = np.repeat(batch.column("id").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["band", "id"])


def possible(agreeing: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether pairs of sets of ``na`` and ``nb`` shingles go on to the exact test.

    The smaller set must be large enough. If it has fewer shingles than there are registers, many of
    these are borrowed and the estimate is not as exact as its limit assumes, so it is not asked.
    """
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (small * OF >= large * SHARE) & ((small < REGISTERS) | (estimate(agreeing) >= ESTIMATE))


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that may be similar, from their registers and numbers of shingles."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ra, rb = (
            np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb")
        )
        good = possible((ra == rb).sum(1), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
        yield batch.select(["a", "b"]).filter(pa.array(good))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact test on full sets."""
    if min(len(a), len(b)) * OF < max(len(a), len(b)) * SHARE:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARE * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linked pairs, from both whole texts; runs of one text are cut once."""
    last: tuple[str | None, np.ndarray] = (None, np.zeros(0, U))
    for batch in batches:
        good = []
        for ta, tb in zip(batch.column("ta"), batch.column("tb")):
            hub = tb.as_py()
            if hub != last[0]:
                last = (hub, shingles(hub))
            good.append(similar(shingles(ta.as_py()), last[1]))
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "shingles"])


def _crowd(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between members of different components within one block of a band.

    Each outsider goes through the others by falling estimate; a link joins their components,
    so that no other member of either is asked again. A pair that shares several bands is
    compared in the first of them only.
    """
    registers = np.frombuffer(b"".join(pdf["registers"]), np.uint16).reshape(-1, REGISTERS)
    band = int((band_keys(registers[:1])[0] == pdf["band"].iloc[0]).argmax())
    ids, labels, outside = pdf["id"].to_numpy(), pdf["label"].to_numpy().copy(), pdf["outside"].to_numpy()
    sets = [np.frombuffer(x, U) for x in pdf["shingles"]]
    sizes = np.array([len(x) for x in sets], np.int64)
    links = []
    for i in np.flatnonzero(outside):
        equal = registers == registers[i]
        first = equal.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
        close = estimate(equal.sum(1))
        asked = np.flatnonzero(possible(equal.sum(1), sizes[i], sizes) & first)
        for j in asked[np.argsort(-close[asked], kind="stable")]:
            if labels[i] != labels[j] and similar(sets[i], sets[j]):
                links.append((ids[i], ids[j]))
                labels[labels == labels[j]] = labels[i]
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": pairs.max(1, initial=-(2**63)), "b": pairs.min(1, initial=2**63 - 1)})


# the operator


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = stored(
        narrow.mapInArrow(_sketches, "doc_id long, n long, print1 long, print2 long, registers binary"), "sketches"
    ).rows
    named = sketched.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    members = ["n", "print1", "print2"]
    classes = stored(
        named.groupBy(*members).agg(
            F.min("doc_id").alias("id"), F.min_by("registers", "doc_id").alias("registers")
        ),
        "classes",
    ).rows
    registers = classes.select("id", "registers")

    # bands with more than one class; most have two, which are the pair
    bands = registers.mapInArrow(_bands, "band long, id long")
    shared = stored(
        bands.groupBy("band")
        .agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("hub"), F.max("id").alias("other"))
        .filter((F.col("size") > 1) & (F.col("hub") != F.col("other"))),
        "bands",
    ).rows
    crowded = stored(shared.filter(F.col("size") > 2).select("band", "hub"), "crowded")
    crowds = stored(bands.join(maybe_broadcast(crowded), "band"), "crowds")
    pairs = (
        shared.filter(F.col("size") == 2)
        .select(F.col("other").alias("a"), F.col("hub").alias("b"))
        .unionByName(crowds.rows.filter(F.col("id") != F.col("hub")).select(F.col("id").alias("a"), F.col("hub").alias("b")))
        .distinct()
    )
    sized = classes.select("id", "registers", "n")
    left, right = (
        sized.select(F.col("id").alias(x), F.col("registers").alias(f"r{x}"), F.col("n").alias(f"n{x}")) for x in "ab"
    )
    links = _verified(
        pairs.join(left, "a").join(right, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(_agreeing, "a long, b long"),
        narrow,
    )
    if crowds.count:
        links = stored(links.rows.unionByName(_crowded(crowds.rows, registers, links.rows, narrow)), "links")

    labels = components(links.rows.unionByName(_joined_by_ids(named, classes, members)))
    by_class = classes.join(labels, "id", "left").select(
        *members, F.coalesce("component_id", "id").alias("class_component")
    )
    out = sketched.join(by_class, members, "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("class_component")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _joined_by_ids(named: DataFrame, classes: DataFrame, members: list[str]) -> DataFrame:
    """Links (a, b) between each document id that stands in several classes and the smallest ids of these."""
    of_class = F.struct(*members)
    several = stored(
        named.groupBy("doc_id").agg(F.min(of_class).alias("a"), F.max(of_class).alias("b")).filter("a <> b").select("doc_id"),
        "several",
    )
    met = named.join(maybe_broadcast(several), "doc_id").select("doc_id", *members)
    found = met.join(classes.select("id", *members), members).filter(F.col("doc_id") != F.col("id"))
    return stored(found.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct(), "joined").rows


def _verified(pairs: DataFrame, docs: DataFrame):
    """Pairs (a, b) that pass the exact test on the whole texts of both."""
    kept = stored(pairs, "pairs")
    involved = stored(
        kept.rows.select(F.col("a").alias("id")).unionByName(kept.rows.select(F.col("b").alias("id"))).distinct(),
        "involved",
    )
    texts = docs.join(maybe_broadcast(involved), F.col("doc_id") == F.col("id"), "left_semi")
    a, b = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    met = kept.rows.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
    return stored(met.mapInArrow(_verify, "a long, b long").distinct(), "links")


def _crowded(crowds: DataFrame, registers: DataFrame, links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links that members of crowded bands outside their hub's component have within the band."""
    labels = components(links)
    of_hub = labels.select(F.col("id").alias("hub"), F.col("component_id").alias("hub_label"))
    told = (
        crowds.join(labels, "id", "left")
        .join(of_hub, "hub", "left")
        .select(
            "band",
            "id",
            F.coalesce("component_id", "id").alias("label"),
            F.coalesce("hub_label", "hub").alias("hub_label"),
        )
        .withColumn("outside", F.col("label") != F.col("hub_label"))
    )
    # blocks of outsiders, each of which meets all blocks of the band's members
    sizes = stored(
        told.groupBy("band")
        .agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("outside").cast("long")).alias("out"))
        .filter("out > 0"),
        "outsiders",
    )
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    placed = (
        told.join(maybe_broadcast(sizes), "band")
        .withColumn("rows_in", blocks("all"))
        .withColumn("outs_in", blocks("out"))
    )
    involved = stored(placed.select("id").distinct(), "involved")
    texts = docs.join(maybe_broadcast(involved), F.col("doc_id") == F.col("id")).select("id", "text")
    # the exact sets; a document of several texts has them all compared
    sets = registers.join(texts.mapInArrow(_sets, "id long, shingles binary"), "id")
    placed = placed.join(sets, "id")
    number = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    carried = ["id", "label", "registers", "shingles"]
    asking = placed.filter("outside").select(
        "band", number("outs_in").alias("o"), F.explode(F.sequence(F.lit(0), F.col("rows_in") - 1)).alias("r"),
        *carried, F.lit(True).alias("outside"),
    )
    asked = placed.select(
        "band", F.explode(F.sequence(F.lit(0), F.col("outs_in") - 1)).alias("o"), number("rows_in").alias("r"),
        *carried, F.lit(False).alias("outside"),
    )
    return asking.unionByName(asked).groupBy("band", "o", "r").applyInPandas(_crowd, "a long, b long")
