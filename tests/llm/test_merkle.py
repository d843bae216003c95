"""The manifest against a plain recursive model, on documents with every odd case."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pareto_frame.llm import merkle
from tests.llm.fixtures import documents


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text) -> str:
    return sha("".join(encoded(x) for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def grow(level: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and the (left, right) siblings of each leaf per level."""
    proofs, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for proof, i in zip(proofs, at):
            first = i - i % 3
            proof.append(("".join(level[first:i]), "".join(level[i + 1 : first + 3])))
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], proofs


def model(rows: list) -> Counter:
    groups: dict = {}
    for row in rows:
        groups.setdefault(row["source"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row, row["text"]), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in order:
        members = sorted(groups[source], key=lambda m: m[:3])
        trees.append((members, *grow([m[2] for m in members])))
    root, above = grow([subroot for _, subroot, _ in trees])
    out: Counter = Counter()
    for (members, subroot, proofs), tail in zip(trees, above):
        for (_, _, own, row), proof in zip(members, proofs):
            text = row["text"]
            if row["doc_id"] is not None and text is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(row, text)
            for left, right in proof + tail:
                folded = sha(left + folded + right)
            siblings = sha("".join(a + b for a, b in proof + tail))
            out[row["doc_id"], own, subroot, root, siblings, folded, folded == root] += 1
    return out


def found(docs) -> Counter:
    rows = merkle.verified(docs).withColumn("proof_sha256", merkle.proof_digest(F.col("proof")))
    return Counter(
        tuple(r) for r in rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    )


@pytest.mark.parametrize("broadcast", [merkle.BROADCAST_BYTES, 0])
def test_odd_documents(spark, monkeypatch, broadcast):
    """Null, empty and long texts, repeated rows, null ids, a null and a hot source; both ways of joining."""
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", broadcast)
    if not broadcast:
        monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 0)
        monkeypatch.setattr(merkle, "CHUNK", 4)
    source = F.when(F.col("doc_id") % 5 < 3, "hot").when(F.col("doc_id") % 5 == 3, F.concat(F.lit("é"), "doc_id"))
    docs = documents(spark).withColumn("source", source).withColumns({"tree": F.lit("x"), "payload": F.lit(1), "leaf": F.lit("y")})
    expected = model(docs.collect())
    assert found(docs) == expected
    assert {k[-1] for k in expected} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 10])
def test_small_tables(spark, n):
    docs = documents(spark, [(i, f"a\n{i}") for i in range(n)])
    assert found(docs) == (model(docs.collect()) if n else Counter())


def test_many_groups_of_one(spark):
    docs = documents(spark, [(i, "same") for i in range(40)]).withColumn("source", F.col("doc_id").cast("string"))
    assert found(docs) == model(docs.collect())


def test_a_very_long_text(spark):
    docs = documents(spark, [(2, "é\n" * 3_000_000), (3, None)])
    assert found(docs) == model(docs.collect())
