"""Mixing, SimHash, token counts, resampling, token files and packing against plain Python."""

import math
import re
import zlib
from collections import Counter as Tally
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bitplanes, components, mixing, packing, resampling, simhash, tokencount
from gridloom.llm.entry import tokenizer
from gridloom.llm.fasttok import Encoder
from gridloom.llm.textcut import cut

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# -- 1: mixing ------------------------------------------------------------------------------------


def water(sizes, share=1.5, cap=2, weights=(5, 2, 1)):
    """Targets by giving out the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        if not rest:
            return full
        level = left / sum(w[s] for s in rest)
        over = [s for s in rest if level * w[s] > cap * sizes[s]]
        if not over:
            return full | {s: level * w[s] for s in rest}
        for s in over:
            full[s] = cap * sizes[s]
            left -= full[s]


def check_mix(rows, docs):
    assert len(rows) == docs.count()
    sizes, taken, target, most = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    where = {(r.doc_id, r.text): r.source for r in docs.select("doc_id", "text", "source").collect()}
    by = defaultdict(list)
    for (i, t), s in where.items():
        by[i].append((t, s))
    for r in rows:
        found = {s for t, s in by[r.doc_id] if len(WORD.findall(t or "")) == r.size}
        assert len(found) == 1
        s = found.pop()
        sizes[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        most[s] = max(most[s], r.size)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1


def test_mixture_equals_sql(duck, docs):
    got = sorted(tuple(r) for r in mixing.mixture(docs).collect())
    names = ["doc_id", "size", "source_size", "target", "taken"]
    assert got == sorted(tuple(r[n] for n in names) for r in duck.sql(mixing.MIXTURE_SQL).to_arrow_table().to_pylist())


def test_mixture_of_odd_rows(odd_docs, no_docs):
    rows = mixing.mixture(odd_docs).collect()
    check_mix(rows, odd_docs)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixture(odd_docs.repartition(5)).collect()))
    assert mixing.mixture(no_docs).count() == 0
    made = mixing.mixed_documents(odd_docs)
    assert made.columns == odd_docs.columns
    tally = Tally((r.doc_id, r.text) for r in made.collect())
    size = {(r.doc_id, r.text): len(WORD.findall(r.text or "")) for r in odd_docs.collect()}
    assert all(n <= 2 * 5 for n in tally.values()) and set(tally) <= set(size)
    assert sum(n * size[k] for k, n in tally.items()) == sum(r.taken for r in rows)
    assert mixing.mixed_documents(no_docs).count() == 0


def test_repeated_rows_are_told_apart(spark):
    df = spark.range(600).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 400, "a").otherwise("b").alias("source"))
    check = {s: 0 for s in "ab"}
    out = mixing.mixture(df)
    for r in out.collect():
        check["a" if r.source_size == 1200 else "b"] += r.taken
        goal = r.target
    targets = water({"a": 1200, "b": 600})
    assert abs(check["a"] - targets["a"]) <= 3 and abs(check["b"] - targets["b"]) <= 3 and goal
    with pytest.raises(ValueError):
        mixing.mixture(df, share=3)


# -- 2: SimHash -----------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else 0
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def groups(prints, most=3):
    """Smallest id reachable, by comparing all pairs."""
    items = list(prints)
    parent = list(range(len(items)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(items):
        for j in range(i):
            if (a ^ items[j][1]).bit_count() <= most:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(items):
        least[find(i)].append(k)
    return [min((k for k in least[find(i)] if k is not None), default=None) for i in range(len(items))]


def check_groups(rows, texts):
    prints = [(i, slow_fingerprint(t)) for i, t in texts]
    want = Tally(zip((i for i, _ in prints), (f"{f:016x}" for _, f in prints), groups(prints), strict=True))
    assert Tally(map(tuple, rows)) == want


def test_near_duplicates(docs, odd_docs, no_docs, spark):
    check_groups(simhash.near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    check_groups(simhash.near_duplicates(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert simhash.near_duplicates(no_docs).count() == 0
    lone = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "q r s t")], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(lone).collect()} == {None, 7}


@pytest.mark.parametrize("most_in_task", [4096, 2])
def test_links_find_every_component(spark, most_in_task):
    """Crowded balls, chains of 1 to 3 bits across both halves, and far values; also by the way for crowded segments."""
    r = np.random.default_rng(1)
    values = {int(x) for x in r.integers(0, 1 << 63, 30)}
    for centre in list(values)[:6]:
        at = centre
        for _ in range(25):
            for b in r.choice(64, r.integers(1, 5), replace=False):
                at ^= 1 << int(b)
            values.add(at)
    for b in range(12):
        values.add((1 << b) | (1 << (b + 40)))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.links(fps, most_in_task)
    for e in edges.collect():
        assert ((e.u ^ e.v) & (2**64 - 1)).bit_count() <= 3
    got = {x.node: x.component for x in components.connected_components(edges).collect()}
    want = groups([(s, v) for s, v in zip(signed, values, strict=True)])
    assert [got.get(s, s) for s in signed] == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 140)] + [(5, 5), (None, 3), (7, 6), (200, 201)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 3: token counts ------------------------------------------------------------------------------


def slow_count(word, pieces):
    text, least = "▁" + word, min(pieces.values()) - tokencount.UNKNOWN
    best = [(0.0, 0)]
    for e in range(1, len(text) + 1):
        size = len(text[e - 1].encode())
        options = [(best[e - 1][0] + least * size, -(-best[e - 1][1] + size))]
        options += [(best[s][0] + pieces[text[s:e]], best[s][1] - 1) for s in range(e) if text[s:e] in pieces]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(docs, odd_docs, no_docs):
    """Every document, the two very long ones too."""
    pieces = tokencount.unigram_pieces(tokenizer("piece_bpe_32k.model"))
    longest, known = max(map(len, pieces)), {}
    for df in (docs, odd_docs):
        want = Tally()
        for r in df.collect():
            words = WORD.findall(r.text or "")
            for w in set(words):
                if w not in known:
                    known[w] = bounded_count(w, pieces, longest)
            want[r.doc_id, len(words), sum(known[w] for w in words)] += 1
        assert Tally(map(tuple, tokencount.token_counts(df, pieces).collect())) == want
    assert tokencount.token_counts(no_docs, pieces).count() == 0
    short = [w for w in known if len(w) < 40][:300]
    assert [known[w] for w in short] == [slow_count(w, pieces) for w in short]


def bounded_count(word, pieces, longest):
    """:func:`slow_count` with pieces of at most ``longest`` characters tried."""
    text, least = "▁" + word, min(pieces.values()) - tokencount.UNKNOWN
    best = [(0.0, 0)]
    for e in range(1, len(text) + 1):
        size = len(text[e - 1].encode())
        options = [(best[e - 1][0] + least * size, best[e - 1][1] - size)]
        options += [(best[s][0] + pieces[text[s:e]], best[s][1] - 1) for s in range(max(0, e - longest), e) if text[s:e] in pieces]
        best.append(max(options))
    return -best[-1][1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc ", max_size=7), max_size=8))
def test_counts_by_trie(words):
    pieces = {"▁a": -1.0, "ab": -1.5, "b": -2.0, "▁": -2.0, "abc": -2.5, "c": -4.0, "bc": -3.0}
    trie, small = tokencount.Trie(pieces), tokencount.Trie(pieces, most=4)
    for part in (words, words[:3]):
        assert list(trie.count(part)) == list(small.count(part)) == [slow_count(w, pieces) for w in part]
    assert trie.made == len({"▁" + w[:k] for w in set(words) for k in range(len(w) + 1)}) == len(trie.score) - 1


# -- 5: resampling --------------------------------------------------------------------------------


def test_resampling(spark, docs, no_docs, odd_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model, scored = resampling.fit(docs, labels)
    rows = scored.collect()
    assert len(rows) == docs.count()
    keys = sorted((r.key for r in rows), reverse=True)
    assert model.cut == keys[model.kept - 1]
    kept = {r.doc_id for r in resampling.resample(docs, labels).collect()}
    assert kept == {r.id for r in rows if r.key >= model.cut}
    again = resampling.kept_documents(docs, labels)
    assert again.columns == docs.columns and {r.doc_id for r in again.collect()} == kept
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(good & kept) >= 0.97 * len(good)
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (3, 1), (4, 1)], "doc_id long, quality int")
    assert resampling.kept_documents(odd_docs, odd).columns == odd_docs.columns
    assert resampling.resample(odd_docs, odd).count() <= odd_docs.count()
    assert resampling.resample(no_docs, labels).count() == 0
    assert resampling.resample(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_held_out_accuracy(spark):
    """On the larger table: held-out good documents stay and held-out junk goes."""
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model, scored = resampling.fit(docs, labels)
    held = scored.filter("held").select("good", (F.col("key") >= model.cut).alias("keep")).groupBy("good").agg(F.avg(F.col("keep").cast("int")).alias("p")).collect()
    share = {r.good: r.p for r in held}
    assert share[True] >= 0.98 and share[False] <= 0.15


def test_short_junk_goes(spark):
    """One long held-out good document with 3 % junk sums lower than short texts of junk only."""
    r = np.random.default_rng(4)
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(460)], "doc_id long, quality int")
    held = min(x["__id"] for x in resampling.labelled_sample(labels, "doc_id", "quality", 10_000).collect() if x["__held"] and x["__good"])
    words = lambda n, junk: " ".join(("junk" if x < junk else "good") + "abcdefghij"[y] for x, y in zip(r.random(n), r.integers(0, 10, n), strict=True))
    rows = [(i, words(3000, 0.03) if i == held else words(50, 0 if i < 400 else 1)) for i in range(460)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, scored = resampling.fit(docs, labels)
    sums = {x.id: x.log_weight for x in scored.collect()}
    assert sums[held] < min(sums[i] for i in range(400, 460))
    assert {x.doc_id for x in resampling.resample(docs, labels).collect()} == set(range(400))
    assert {x.doc_id for x in resampling.kept_documents(docs, labels).collect()} == set(range(400))


def test_log_weights_by_hand():
    texts = pa.array(["a b", None, "", "b b b", "a b"])
    words, n, pairs, m = resampling.features(texts)
    assert list(n) == [2, 0, 0, 3, 2] and list(m) == [1, 0, 0, 2, 1]
    ratio = resampling.log_ratio(np.bincount(words, minlength=resampling.BUCKETS), np.ones(resampling.BUCKETS))
    got = resampling.log_weights(texts, ratio)
    assert got[0] == pytest.approx(ratio[words[:2]].sum() + ratio[pairs[0]]) and got[1] == got[2] == 0 and got[0] == got[4]
    assert math.isclose(np.exp(resampling.log_ratio(np.array([3.0, 1]), np.array([1.0, 1])))[0], (4 / 6) / (2 / 4))


def test_kth_largest(spark):
    values = [0.5, 2.0, 2.0, -3.0, 7.25, 1e-9, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for bins in (2, 4096):
        assert [resampling.kth_largest(df, "x", k, bins) for k in range(1, 8)] == sorted(values, reverse=True)


# -- tokenizing, 6: token files -------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, docs, odd_docs):
    encoder, plain = Encoder(tokenizer(name), remembered=200_000), Tokenizer.from_file(tokenizer(name))
    texts = [r.text for r in docs.select("text").limit(60).collect()] + [r.text for r in odd_docs.collect()]
    for part in (texts, texts[::-1], texts, [], [None]):
        assert encoder.bytes <= 200_000
        flat, n = encoder.encode(pa.array(part, pa.string()), 9)
        at = 0
        for t, k in zip(part, n, strict=True):
            assert list(flat[at : at + k]) == [*plain.encode(t or "", add_special_tokens=False).ids, 9]
            at += k


_ENCODERS: list[Encoder] = []


def test_no_encoder_outlives_its_task(spark, docs):
    """Whatever ran in a worker before, it holds no encoder and no remembered chunks."""

    def left(batches):
        import gc

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(type(x).__name__ in ("Encoder", "Tokenizer", "Trie") and type(x).__module__.startswith(("gridloom", "tokenizers")) for x in gc.get_objects())], pa.int64())})

    packing.packed_digests(docs, tokenizer("word_bpe_49k.json")).agg(F.sum("length")).collect()
    bitplanes.token_file_digests(docs, tokenizer("byte_bpe_50k.json")).agg(F.sum("n_tokens")).collect()
    tokencount.token_counts(docs, {"a": -1.0}).agg(F.sum("n_tokens")).collect()
    assert {r.n for r in spark.range(0, 40, 1, 16).mapInArrow(left, "n long").collect()} == {0}


def test_files_are_read_back_by_bytes():
    parts = list(bitplanes._batches(np.full(1000, 25_000)))
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]] and parts[0][0] == 0 and parts[-1][1] == 1000
    assert all(4 * 25_000 * (b - a) <= bitplanes.BATCH_BYTES for a, b in parts)
    assert list(bitplanes._batches(np.array([1, 5_000_000, 1, 1]))) == [(0, 1), (1, 2), (2, 4)] and not list(bitplanes._batches(np.zeros(0, np.int64)))
    assert list(bitplanes._batches(np.ones(2500, np.int64))) == [(0, 1000), (1000, 2000), (2000, 2500)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é,.\n\t'!1<| 　\x1c"), max_size=12), max_size=5))
def test_cuts_are_safe(texts):
    for encoder in _ENCODERS or _ENCODERS.extend(Encoder(tokenizer(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json")) or _ENCODERS:
        flat, n = encoder.encode(pa.array(texts, pa.string()), 0)
        ends = np.cumsum(n)
        for t, e, k in zip(texts, ends, n, strict=True):
            assert list(flat[e - k : e - 1]) == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    for words in (False, True):
        codes, distinct, firsts, _ = cut(pa.array(texts, pa.string()), words)
        parts = [distinct[int(c)].as_py() for c in codes]
        assert ["".join(parts[a:b]) for a, b in zip(firsts, firsts[1:])] == texts


def digests(rows, name, end):
    plain = Tokenizer.from_file(tokenizer(name))
    return {k: np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], "<u4") for k, t in rows}


def test_token_files(docs, odd_docs, no_docs, spark):
    want, start = digests([(r.doc_id, r.text) for r in docs.collect()], "byte_bpe_50k.json", 0), 0
    got = {r.doc_id: r for r in bitplanes.token_file_digests(docs, tokenizer("byte_bpe_50k.json")).collect()}
    assert len(got) == len(want)
    for k in sorted(want):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(want[k]), zlib.crc32(want[k].tobytes()))
        start += len(want[k])
    for planes in ("bit", "byte"):
        from gridloom.llm._base import scratch

        index = bitplanes.write_token_files(odd_docs, scratch(spark, "t"), tokenizer("byte_bpe_50k.json"), block=1000, planes=planes)
        rows = bitplanes.read_token_files(index).orderBy("start").collect()
        assert len(rows) == odd_docs.count() and [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])
        keys = [r.id for r in rows]
        assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
        texts = Tally((k, w.tobytes()) for k, w in ((r.doc_id, digests([(0, r.text)], "byte_bpe_50k.json", 0)[0]) for r in odd_docs.collect()))
        assert Tally((r.id, bytes(r.ids)) for r in rows) == texts
    assert bitplanes.token_file_digests(no_docs, tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_plane_files(tmp_path, planes):
    r = np.random.default_rng(0)
    ids = r.integers(0, 1 << 32, 2500, dtype=np.uint32)
    for n in (1, 7, 8, 1000):
        assert (bitplanes.from_planes(bitplanes.to_planes(ids[:n], planes), n) == ids[:n]).all()
    at = tmp_path / "x"
    with at.open("wb") as out:
        to = bitplanes.Writer(out, 512, planes)
        to.add(ids[:100], np.array([1, 2]), np.array([True, False]), np.array([60, 40]))
        to.add(ids[100:], np.array([3]), np.array([True]), np.array([2400]))
        to.close()
    with at.open("rb") as source:
        back = bitplanes.Reader(source, at.stat().st_size)
        assert [len(x) for x in back.documents()] == [60, 40, 2400] and (np.concatenate(list(back.documents())) == ids).all()
        for a, n in ((0, 1), (511, 2), (2499, 1), (1000, 1500), (5, 0)):
            assert (back.read(a, n) == ids[a : a + n]).all()
    with pytest.raises(ValueError):
        bitplanes.Writer(None, planes="nibble")


# -- 9: packing -----------------------------------------------------------------------------------


def check_packing(pieces, want, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == list(np.cumsum([0, *(p.length for p in s)])[:-1])
        assert sum(p.length for p in s) <= capacity
    return by_doc, len(by_sequence)


def test_packing(docs, odd_docs, no_docs):
    want = digests([(r.doc_id, r.text) for r in docs.collect()], "word_bpe_49k.json", 2)
    pieces = packing.packed_digests(docs, tokenizer("word_bpe_49k.json")).collect()
    by_doc, n = check_packing(pieces, want, 4096)
    for k, ids in want.items():
        parts = sorted(by_doc[k], key=lambda p: p.start)
        assert [p.start for p in parts] == list(np.cumsum([0, *(p.length for p in parts)])[:-1])
        assert sum(p.length for p in parts) == len(ids) == parts[0].doc_tokens
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in parts)
    total = sum(map(len, want.values()))
    assert n <= total / 4096 * 1.03 + 2
    small = packing.pack(odd_docs, tokenizer("word_bpe_49k.json"), 64, group_tokens=3000).collect()
    check_packing(small, None, 64)
    ids = Tally()
    for r in odd_docs.collect():
        ids[r.doc_id] += len(digests([(0, r.text)], "word_bpe_49k.json", 2)[0])
    got = Tally()
    for p in small:
        got[p.doc_id] += p.length
        assert len(p.ids) == 4 * p.length
    assert got == ids
    assert packing.pack(no_docs, tokenizer("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer("word_bpe_49k.json"), 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40))
def test_first_fit_decreasing(sizes):
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(40)
        room[k] -= sizes[i]
        want[i] = k
    assert list(packing.first_fit_decreasing(np.array(sizes, np.int64), 40)) == want
