"""The operators on documents, against brute force on a fixture with every odd case."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pareto_frame.llm import hyperminhash, language, lines, packing, secret_scan, token_files
from pareto_frame.llm.bpe import Bpe, round_trip
from pareto_frame.llm.common import stored
from tests.llm.fixtures import documents, odd_rows, shingles, smallest_reachable

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids_of(path: str, text: str | None) -> list[int]:
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    return stored(documents(spark), "odd").rows


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


# near-duplicates


def test_near_duplicates_match_brute_force(docs):
    rows = [(i, t) for i, t in odd_rows()]
    sets = [(i, shingles(t)) for i, t in rows]
    named = [(i, s) for i, s in sets if i is not None and s]
    linked = [
        (a, b)
        for (a, s), (b, t) in itertools.combinations(named, 2)
        if 100 * len(s & t) >= 75 * len(s | t)
    ]
    reach = smallest_reachable({i for i, _ in rows if i is not None}, linked)
    expected = Counter((i, len(s), None if i is None else reach[i] if s else i) for i, s in sets)
    found = hyperminhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_crowded_bands_lose_no_link(spark):
    """A chain: each text is similar to the next ones only, and all share bands with many."""
    words = [f"w{i}" for i in range(260)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(40)]
    sets = [(i, shingles(t)) for i, t in rows]
    linked = [(a, b) for (a, s), (b, t) in itertools.combinations(sets, 2) if 100 * len(s & t) >= 75 * len(s | t)]
    reach = smallest_reachable(range(40), linked)
    found = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(documents(spark, rows)).collect()}
    assert found == reach and linked


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for shared in (0, 1000, 2500, 3900):
        a, b = np.unique(pool[: 2000 + shared // 2]), np.unique(pool[2000 - shared // 2 :])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        agreeing = (hyperminhash.sketch(a) == hyperminhash.sketch(b)).sum()
        assert abs(hyperminhash.estimate(agreeing) - true) < 0.15


def test_full_and_partly_empty_sketches_agree():
    """One set fills all registers and the other does not: the filled ones stay as they are."""
    pool = np.unique(np.random.default_rng(6).integers(0, 2**63, 1500).astype(np.uint64))
    bucket = (pool >> np.uint64(48)) * np.uint64(hyperminhash.REGISTERS) >> np.uint64(16)
    without = pool[bucket != bucket[700]]
    agreeing = (hyperminhash.sketch(pool) == hyperminhash.sketch(without)).sum()
    assert agreeing >= hyperminhash.REGISTERS - 2


def test_the_estimate_drops_no_short_pair(spark):
    """Texts of 8 words and their first 7: similarity 0.75, a shared band, and registers that say less."""
    rng, rows, pairs = np.random.default_rng(12), [], []
    while len(pairs) < 3:
        words = [f"w{x}" for x in rng.integers(0, 10**6, 8)]
        texts = [" ".join(words), " ".join(words[:7])]
        sets = [hyperminhash.shingles(t) for t in texts]
        sketches = np.stack([hyperminhash.sketch(s) for s in sets])
        keys = hyperminhash.band_keys(sketches)
        agreeing = (sketches[0] == sketches[1]).sum()
        if (keys[0] == keys[1]).any() and hyperminhash.estimate(agreeing) < hyperminhash.ESTIMATE:
            pairs.append((sets, sketches, keys[0][keys[0] == keys[1]][0]))
            rows += [(len(rows) + i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r.component_id for r in hyperminhash.near_duplicates(documents(spark, rows)).collect()}
    assert found == {i: i // 2 * 2 for i in range(6)}
    for sets, sketches, key in pairs:
        block = pd.DataFrame({
            "band": [key] * 2, "id": [5, 6], "label": [5, 6], "outside": [True, False],
            "registers": [x.tobytes() for x in sketches], "shingles": [x.tobytes() for x in sets],
        })
        assert hyperminhash._crowd(block).values.tolist() == [[6, 5]]


def test_an_id_of_several_texts_joins_their_classes(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(0, x), (1, x), (1, y), (2, y), (3, z), (4, z), (5, z), (5, None)]
    found = Counter(tuple(r) for r in hyperminhash.near_duplicates(documents(spark, rows)).select("doc_id", "component_id", "kept").collect())
    expected = [(0, 0, True), (1, 0, False), (1, 0, False), (2, 0, False), (3, 3, True), (4, 3, False), (5, 3, False), (5, 5, True)]
    assert found == Counter(expected)


# lines


def within_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    n = min(len(a), len(b))
    first = next((i for i in range(n) if a[i] != b[i]), n)
    return a[first + (len(a) >= len(b)) :] == b[first + (len(b) >= len(a)) :]


def test_lines_match_brute_force(docs):
    rows = odd_rows()
    key = lambda i, n: (i is not None, i or 0, n)
    places: dict[str, tuple] = {}
    for i, t in rows:
        for n, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip(" "):
                places[line] = min(places.get(line, key(i, n)), key(i, n))
    near = {
        a
        for a, b in itertools.permutations([x for x in places if len(x) >= lines.MIN_CHARS], 2)
        if within_one(a, b) and places[b] < places[a]
    }
    expected = Counter()
    for i, t in rows:
        if t is None:
            expected[(i, None, 0)] += 1
            continue
        kept = [
            line
            for n, line in enumerate(t.split("\n"))
            if not line.strip(" ") or (places[line] == key(i, n) and line not in near)
        ]
        expected[(i, "\n".join(kept), len(t.split("\n")) - len(kept))] += 1
    found = lines.dedup_lines(docs)
    assert found.columns == [*[c for c in docs.columns if c != "removed"], "removed"]
    assert Counter((r.doc_id, r.text, len(r.removed)) for r in found.collect()) == expected
    assert near


def test_variant_keys_meet_within_one_edit():
    for a, b in (("abcdefgh", "abcdxfgh"), ("abcdefgh", "abcdefg"), ("aaaaaaa", "aaaaaa"), ("éa" * 9, "éa" * 8 + "é")):
        keys = [set(lines.variant_keys(x, True, True)[0].tolist()) for x in (a, b)]
        assert keys[0] & keys[1], (a, b)


# language


def test_language_learns_and_rejects(spark):
    rows = []
    for i in range(400):
        rows.append((i, ["und der die nicht schön", "los las que señor niño"][i % 2] + f" wort{i}" * (i % 3), ["de", "es"][i % 2]))
    rows += [(1000, None, "de"), (1001, "123 !!", "de"), (1002, "", None), (None, "der die und", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    found = language.predict(df, model).withColumn("out", language.held_out(F.col("doc_id"))).collect()
    for r in found:
        if r.doc_id is None or r.doc_id < 1000:
            assert r.lang_pred == r.lang and 0 <= r.score <= 1
            assert r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        else:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)


def test_texts_of_an_unlearned_language_are_rejected():
    words = {
        "de": "und der die nicht schön wort haus straße über zwischen".split(),
        "es": "los las que señor niño casa calle sobre entre pueblo".split(),
        "xx": "kwyj zbqa ghxv pmwk jjry vvkz qoxh".split(),
    }
    rng = np.random.default_rng(13)
    text = lambda name: " ".join(rng.choice(words[name], 40))
    learned = [(i, name, language.examples(text(name), i)) for i in range(300) for name in ("de", "es")]
    model = language.fit(learned, language.Settings())
    rejected = lambda name: np.mean([model.predict(text(name))[1] < model.threshold for _ in range(100)])
    assert rejected("de") <= 0.01 and rejected("es") <= 0.01
    assert rejected("xx") >= 0.9


def test_language_without_labels(docs, none):
    model = language.train(none)
    assert language.predict(none, model).count() == 0
    assert {r.lang_pred for r in language.predict(docs, model).collect()} == {"und"}
    assert language.predict(docs, model).columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score", "rejected"]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = spark.read.parquet(f"{folder}/documents.parquet")
    told = language.predict(found, language.train(found)).filter(language.held_out(F.col("doc_id")))
    right, total = told.agg(F.sum((F.col("lang_pred") == F.col("lang")).cast("int")), F.count(F.lit(1))).first()
    assert right / total > 0.97


# packing


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(documents=3, attention=2 * 2048**2, rule="dot")])
def test_packing(docs, capacity):
    found = packing.pack(packing.cut(docs, BYTE), capacity).toPandas()
    expected = Counter()
    for i, t in odd_rows():
        ids = [*ids_of(BYTE, t), 0]
        start, end, piece = 0, len(ids) % 2048 or 2048, 0
        while start < len(ids):
            expected[(i, piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes()))] += 1
            start, end, piece = end, end + 2048, piece + 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = Counter(tuple(None if c == "doc_id" and x != x else int(x) for c, x in zip(columns, row)) for row in found[columns].values)
    assert got == expected
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        assert (rows.offset.to_numpy() == np.r_[0, rows.length.cumsum()[:-1]]).all()
        assert rows.length.sum() <= capacity.tokens and len(rows) <= capacity.documents
        assert (rows.length**2).sum() <= capacity.attention


def test_packing_needs_few_sequences():
    rng = np.random.default_rng(2)
    counts = np.bincount(np.minimum(2048, rng.lognormal(6, 1, 5000).astype(int) + 1), minlength=2049)
    plan = packing.plan(counts, packing.Capacity())
    used = (plan[:, 3] + plan[:, 2] - plan[:, 1]).max()
    assert used <= 1.01 * (counts @ np.arange(2049)) / 2048 + 1


def test_packing_of_nothing(none):
    assert packing.pack(packing.cut(none, BYTE)).count() == 0


# ids and files


def test_round_trip(docs):
    tokenizer = Tokenizer.from_file(WORD)
    expected = Counter()
    for i, t in odd_rows():
        ids = ids_of(WORD, t)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected[(i, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(tuple(r) for r in round_trip(docs, WORD).collect()) == expected


def test_long_words_go_through_the_window(monkeypatch):
    monkeypatch.setattr("pareto_frame.llm.bpe.WINDOW", 4)
    bpe, rng = Bpe(WORD), np.random.default_rng(3)
    for letters in ("ab", "theraning", "aeiounst", "a", "éa"):
        text = "".join(rng.choice(list(letters), 2000))
        assert list(bpe.encode(text)) == ids_of(WORD, text)
    assert "".join(bpe.plain(bpe.encode("Naïve 🙂 text"))) == "naïve 🙂 text "


def test_token_files(docs, none):
    folder = token_files.write_tokens(docs, WORD, 2)
    found = sorted(tuple(r) for r in token_files.read_documents(docs.sparkSession, folder).select("start", "n_tokens", "ids_crc32", F.coalesce("doc_id", F.lit(-1))).collect())
    expected = Counter()
    for i, t in odd_rows():
        ids = np.array([*ids_of(WORD, t), 2], "<u4")
        expected[(-1 if i is None else i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((i, n, c) for _, n, c, i in found) == expected
    assert [s for s, *_ in found] == list(np.r_[0, np.cumsum([n for _, n, *_ in found])[:-1]])
    assert [i for *_, i in found] == sorted(i for *_, i in found)
    assert token_files.read_documents(docs.sparkSession, token_files.write_tokens(none, WORD, 2)).count() == 0


def test_look_up_of_given_documents(docs):
    folder = token_files.write_tokens(docs, WORD, 2)
    every = Counter(tuple(r) for r in token_files.read_documents(docs.sparkSession, folder).collect())
    wanted = sorted({r[0] for r in every if r[0] is not None})[::3] + [1, 5, 10**9]
    found = Counter(tuple(r) for r in token_files.look_up(docs.sparkSession, folder, wanted).collect())
    assert found == Counter({r: n for r, n in every.items() if r[0] in wanted}) and sum(found.values()) > 10
    assert token_files.look_up(docs.sparkSession, folder, []).count() == 0


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 2000])
def test_elias_fano(n):
    ends = np.cumsum(np.random.default_rng(n).integers(0, 5000, n))
    code = token_files.ef_encode(ends)
    assert (token_files.ef_decode(n, *code[:3]) == ends).all()
    assert [token_files.ef_select(i, *code) for i in range(n)] == list(ends)
    if n > 100:
        assert len(code[1]) + len(code[2]) <= n * (2 + np.log2(ends[-1] / n)) / 8 + 16


# secrets


def spans_of(text: str | None) -> list[tuple]:
    out = []
    plain = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
        ("hex", re.compile("[0-9a-f]+"), 0, 24),
        *[(r.kind, re.compile(r.pattern), r.group, r.least) for r in secret_scan.MORE_RULES],
    ]
    for order, (kind, pattern, group, least) in enumerate(plain):
        out += [(m.start(), order, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


def test_secrets(docs, none):
    found = secret_scan.find_secrets(docs).select("doc_id", "text", secret_scan.spelled(F.col("secret_spans")).alias("s"), secret_scan.redact(F.col("text"), F.col("secret_spans")).alias("clean")).collect()
    expected = Counter((i, ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans_of(t))) for i, t in odd_rows())
    assert Counter((r.doc_id, r.s) for r in found) == expected
    assert any(r.s.count(":") > 8 for r in found)
    for r in found:
        assert not r.s or ("[" in r.clean and not spans_of(r.clean.replace("[", " ")))
        assert r.s or r.clean == r.text
    assert secret_scan.find_secrets(none).count() == 0


def test_trigram_queries():
    by_kind = {r.kind: secret_scan.trigram_query(r) for r in secret_scan.RULES}
    assert by_kind["hex"] is None
    assert frozenset(["tok", "oke", "ken"]) in by_kind["assign"]
    assert by_kind["access"] == [frozenset(["aki", "kia"])]


def test_empty_tables(none):
    assert hyperminhash.near_duplicates(none).count() == 0
    assert lines.dedup_lines(none).count() == 0
    assert round_trip(none, WORD).count() == 0
