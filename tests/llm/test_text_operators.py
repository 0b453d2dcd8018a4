"""Operators 1, 2, 3, 6, 7, 10 against brute force, libraries and round trips; odd inputs."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import bpe, langid, packing, simhash, substrings, toxicity
from folio.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = [
    "", "  ", " a", " \n a", "a  b\n\n\nc ", "A.", "a.b, c.. d.'s it's, x　 y", "x́. e", "É,\r\n. . , ,", "\x1c a\x1d b", "日本語テキスト 123 45a6", "'s 's'S", "!!!,", "Ã×. ×,",
    "😀 a😀.", "ÀÉ× ÷.ß ÿ. ΣΑΣ. İ", "<|endoftext|>.", "É. Ã́. á,", "ﬁ. K", "x" * 3000 + " " + "ab " * 2000,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", None, None) for i, t in enumerate(ODD)]
    rows += [(100, None, None, None, None), (101, None, "fr", "s", 1), (None, "no id here", "en", None, 5), (3, ODD[3], "en", None, None), (3, ODD[3], "en", None, None)]
    clash = ["score", "fp", "n_tokens", "lang_pred", "runs", "spans", "node", "component", "draw", "shard", "__doc"]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(7) for c in clash})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120).cache()


def collected(df, *cols):
    return sorted(df.select(*cols).collect(), key=repr)


# --- 6 -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(odd, small, library):
    for docs in (odd, small):
        for r in bpe.bpe_digest(docs, RANKS, P.PATTERN).collect():
            ids = library.encode_ordinary(r.text or "")
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_bpe_round_trip(odd):
    made = bpe.bpe_decode(bpe.bpe_encode(odd, RANKS, P.PATTERN), RANKS)
    assert all(r.decoded == (r.text or "") for r in made.collect())


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(3000)]
    found = bpe.PerfectHash(keys)
    assert [found.index(k) for k in keys] == list(range(3000)) and sorted(found.place.tolist()) == list(range(3000))


def test_long_word_is_merged_whole(library):
    coder = bpe.coder(RANKS, P.PATTERN)[0]
    word = "".join(random.Random(5).choice("abcdefgh") for _ in range(5000))
    assert coder.encode(word) == library.encode_ordinary(word)


# --- 3 -------------------------------------------------------------------------


def test_packing_places_every_piece(odd, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    for docs in (odd, small):
        rows = packing.pack(docs, WORDS, capacity=256, shard_pieces=40).collect()
        want = []
        for d in docs.collect():
            ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
            want += [(d.doc_id, k, k * 256, len(ids[k * 256 :][:256]), zlib.crc32(np.array(ids[k * 256 :][:256], "<u4").tobytes())) for k in range(-(-len(ids) // 256))]
        assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in by.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 256
        assert len(by) <= 1.06 * -(-sum(r.length for r in rows) // 256) + 2


def test_packing_of_nothing(empty):
    assert packing.pack(empty, WORDS).collect() == []


def test_packing_of_pieces_that_fill_no_sequence(spark):
    docs = spark.range(2100).select(F.col("id").alias("doc_id"), F.expr("repeat('the ', 1199)").alias("text"))
    rows = packing.pack(docs, WORDS).collect()
    assert sorted(r.doc_id for r in rows) == list(range(2100)) and len({r.sequence_id for r in rows}) == 2100
    assert {(r.piece, r.start, r.length, r.offset) for r in rows} == {(0, 0, 1200, 0)}


def test_genetic_steps_keep_every_item():
    ga = packing.Shard(np.random.default_rng(1).integers(1, 900, 200), 1000, (1,))
    pool = ga.evolve([], 6, 30)
    for bins in pool:
        assert sorted(i for b in bins for i in b) == list(range(200)) and all(ga.fill(b) <= 1000 for b in bins)
    assert len(pool[0]) <= len(ga.best_fit([], ga.decreasing(list(range(200)))))


# --- 2 -------------------------------------------------------------------------


def brute_fingerprint(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, near):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in near:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(odd, small):
    for docs in (odd, small):
        rows = simhash.simhash_components(docs, tile=32).collect()
        texts = {d.doc_id: d.text for d in docs.collect()}
        fps = {i: brute_fingerprint(t) for i, t in texts.items()}
        assert len(rows) == docs.count() and all(int(r.fingerprint, 16) == fps[r.doc_id] and len(r.fingerprint) == 16 for r in rows)
        ids = [i for i in fps if i is not None]
        want = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
        assert all(r.component_id == want.get(r.doc_id) for r in rows)


def test_simhash_joins_what_an_id_repeats(spark):
    rows = [(5, "one two three four"), (5, "entirely other words are here now"), (2, "one two three four"), (9, "entirely other words are here now")]
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 2, 2: 2, 9: 2}


def test_tiles_skip_nothing_near():
    x = np.random.default_rng(0).integers(0, 2**63, 800, dtype=np.uint64)
    x[400:] = x[:400] ^ (np.uint64(1) << np.arange(400, dtype=np.uint64) % np.uint64(64))
    got = {(i, j) for a, b in simhash.tile_links(x, x, 3, 64) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(800) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x) <= 3).tolist()}


def test_a_large_group_gives_forests_not_pairs(spark):
    base, r = 0x0F0F_3C3C_5555_1234, random.Random(3)
    fps = sorted({base ^ (1 << r.randrange(63)) ^ (1 << r.randrange(63)) for _ in range(3000)})
    reps = spark.createDataFrame([(fp, i) for i, fp in enumerate(fps)], "fp long, node long")
    links = simhash.near_links(reps, 3, 400)
    near = sum((a ^ b).bit_count() <= 3 for k, a in enumerate(fps) for b in fps[:k])
    assert len(fps) > 1000 and near > 20_000 and links.count() < 20 * len(fps)
    want = brute_components(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert brute_components(range(len(fps)), [(x.u, x.v) for x in links.collect()]) == want


def test_simhash_empty_and_dedup(spark, empty):
    assert simhash.simhash_components(empty).collect() == []
    docs = spark.createDataFrame([(2, "a b c d", "x"), (1, "a b c d", "y"), (3, "other words in this one", None), (None, "a b c d", "z")], "doc_id long, text string, fp string")
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]


def test_near_copies_against_brute_force(spark):
    r = random.Random(5)
    texts = []
    for copies, n, edits in [(60, 150, 1), *((3, r.randrange(6, 300), e) for e in range(12) for _ in range(3))]:
        base = [f"w{r.randrange(5000)}" for _ in range(n)]
        for _ in range(copies):
            own = list(base)
            for _ in range(edits):
                own[r.randrange(n)] = f"v{r.randrange(5000)}"
            texts.append(" ".join(own))
    r.shuffle(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    of = brute_components(range(len(sets)), near)
    kept = simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert len(near) > 1000 and sorted(x.doc_id for x in kept.collect()) == sorted(set(of.values()))


def test_common_counts():
    r = np.random.default_rng(2)
    a, b = ([np.unique(r.integers(0, 60 if i % 3 else 5000, r.integers(1, 40))) for i in range(n)] for n in (50, 70))
    pack = lambda x: (np.concatenate(x), np.array([len(s) for s in x]))
    assert (simhash.common_counts(pack(a), pack(b)) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_a_group_of_loose_copies_in_chunks(spark):
    """Copies of which only some pairs reach 0.8: chunks of a component lose no link and add none."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for _ in range(240):
        own = list(base)
        for _ in range(r.randrange(1, 7)):
            own[r.randrange(160)] = f"v{r.randrange(9000)}"
        texts.append(" ".join(own))
    sets = [{tuple(w[i : i + 5]) for i in range(156)} for w in (t.split() for t in texts)]
    near = [(i, j) for i in range(240) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = simhash._sketches(docs, 5).groupBy("key").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("fp", "fp2", "n")))
    links = simhash.similar_links(docs, reps, 5, 20, 34, 64, chunk_sets=40)
    node = {x.key: x.node for x in reps.collect()}
    found = [(node[x.u], node[x.v]) for x in links.collect()]
    assert brute_components(range(240), found) == brute_components(range(240), near) and len(set(brute_components(range(240), near).values())) > 1


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(80)}


# --- 7 -------------------------------------------------------------------------


def brute_substrings(rows, window):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        gone = [0] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [1] * window
            seen.add(k)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substrings_against_brute_force(spark, small):
    rnd = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(60)))) for i in range(40)] + [(100 + i, "x " * rnd.randrange(80)) for i in range(5)] + [(200, None), (201, "")]
    rows += [(300 + i, f"u{i} v{i} " + passage + f" y{i}") for i in range(20)]
    for data, window, gram in ((rows, 6, 2), (rows, 20, 6), ([(r.doc_id, r.text) for r in small.collect()], 20, 6)):
        docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "at", "n", "spans", "anchor")})
        want = brute_substrings(data, window)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup_substrings(docs, window, gram).collect()}
        assert got == {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for d, (n, k, t) in want.items()}
        cut = {r.doc_id: r.text for r in substrings.remove_repeats(docs, window, gram).collect()}
        assert cut == {d: (want[d][2] if want[d][1] else t) for d, t in data}


def test_factors_are_a_parse(spark, small):
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(90)]
    rows = [(i, " ".join([f"a{i}"] * rnd.randrange(9) + passage[rnd.randrange(30) : 60 + rnd.randrange(30)] + ["b"] * rnd.randrange(30) + passage[: rnd.randrange(70)])) for i in range(40)]
    for data in (rows, [(r.doc_id, r.text) for r in small.collect()]):
        split = {d: re.findall("[^\x20\x09-\x0d]+", t or "") for d, t in data}
        found = {r.doc_id: r.factors for r in substrings.factors(spark.createDataFrame(data, "doc_id long, text string")).collect()}
        want = {d: n for d, (_, n, _) in brute_substrings(data, 20).items() if n}
        assert {d: sum(f.length for f in fs) for d, fs in found.items()} == want
        for d, fs in found.items():
            end, before = 0, None
            for f in fs:
                assert f.start >= end and f.length > 0 and (f.ref_doc, f.ref_start) < (d, f.start)
                assert split[d][f.start : f.start + f.length] == split[f.ref_doc][f.ref_start : f.ref_start + f.length]
                assert before != (f.ref_doc, f.ref_start - f.start, f.start)  # else the factor before would have gone on
                end = f.start + f.length
                before = (f.ref_doc, f.ref_start - f.start, end)


def test_a_long_copy_is_one_factor(spark):
    text = " ".join(f"w{i}" for i in range(500))
    docs = spark.createDataFrame([(1, text), (2, "x y " + text + " z")], "doc_id long, text string")
    assert [[tuple(f) for f in r.factors] for r in substrings.factors(docs).collect()] == [[(2, 500, 1, 0)]]


def test_substrings_odd(spark, odd, empty):
    assert substrings.dedup_substrings(empty).collect() == []
    rows = substrings.dedup_substrings(odd).collect()
    assert len(rows) == odd.count() and all(r.n_removed == 0 for r in rows if r.doc_id in (3, None))
    cut = substrings.remove_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()


# --- 1 -------------------------------------------------------------------------


def test_code_lengths_are_exact(small):
    model = langid.fit(small)
    languages = len(model.languages)
    counts, followers, totals = ({} for _ in range(3))
    for key, lang, n in zip(model.grams.tolist(), model.language.tolist(), model.counts.tolist(), strict=True):
        whole = key.to_bytes(5, "big")
        for k in range(1, 6):
            g = whole[5 - k :]
            if (g, lang) not in counts:
                followers[g[:-1], lang] = followers.get((g[:-1], lang), 0) + 1
            counts[g, lang] = counts.get((g, lang), 0) + n
            totals[g[:-1], lang] = totals.get((g[:-1], lang), 0) + n

    def bits(past, byte, lang, k):
        if k == 0:
            return 8.0
        context = past[len(past) - (k - 1) :] if k > 1 else b""
        n = totals.get((context, lang), 0)
        if not n:
            return bits(past, byte, lang, k - 1)
        u, own = followers[context, lang], counts.get((context + bytes([byte]), lang), 0)
        return -np.log2(own / (n + u)) if own else -np.log2(u / (n + u)) + bits(past, byte, lang, k - 1)

    texts = ["The xqz", "日本 abc", "", "Ber er bestver. Von", small.first().text[:200]]
    import pyarrow as pa

    whole = langid.code_lengths(pa.array(texts), model)
    got = np.concatenate([langid.Trees(*model.table(k, k + 1)).code_lengths(pa.array(texts)) for k in range(languages)], axis=1)
    assert got == pytest.approx(whole, rel=1e-12)
    for i, t in enumerate(texts):
        raw = b"\0" * 4 + t.encode()
        for lang in range(languages):
            assert got[i, lang] == pytest.approx(sum(bits(raw[j - 4 : j], raw[j], lang, 5) for j in range(4, len(raw))), rel=1e-9, abs=1e-9)


def test_languages_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97 and all(0 <= r.score <= 1 for r in found)


def test_every_label_is_learned(spark):
    words = lambda k: " ".join(f"{chr(0x4E00 + 7 * k + j)}{chr(0x4E00 + 7 * k + j + 1)}" for j in range(6))
    rows = [(i, words(i % 250), f"l{i % 250:03}") for i in range(2000)]
    found = langid.predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=100_000).collect()
    assert len({r.lang_pred for r in found}) == 250 and np.mean([r.lang_pred == rows[r.doc_id][2] for r in found]) > 0.99


def test_language_odd(spark, odd, empty):
    assert langid.predict_languages(empty).collect() == []
    rows = langid.predict_languages(odd).collect()
    for r, d in zip(sorted(rows, key=lambda r: repr(r.doc_id)), sorted(odd.collect(), key=lambda r: repr(r.doc_id)), strict=True):
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, d.text or ""))) and (r.lang_pred != "und" or r.score == 0)
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict_languages(unlabelled).collect()} == {"und"}
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and all(any(map(str.isalpha, r.text)) and r.score == 7 for r in kept.collect())


# --- 10 ------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("St00pid 1D1OT! pathétic, lоser 123 a1b2 3.14 $cum") == " stoopid idiot pathetic loser 123 a1b2 3 14 scum "
    assert toxicity.fold("p0rn0 5h17 b1tch35 id10t5 a$$ mp3 100 2026 covid19 idiot!") == " porno shit bitches idiots ass mp3 100 2026 covid19 idiot "


def test_many_stems_and_long_words(spark):
    rnd = random.Random(6)
    name = lambda k: "".join("bdfgklmnprst"[(k // 12**j) % 12] + "aeiou"[(k + j) % 5] for j in range(3))
    rows, labels = [], []
    for i in range(64_000):
        words = [f"w{rnd.randrange(400)}" for _ in range(8)]
        bad = i % 8 == 0
        if bad:
            words[3] = "z" * 60 if i % 400 == 0 else name(i // 8 % 240) + rnd.choice(["x", "y", "v", "q"])
        elif i % 24 == 1:
            words[3] = name(i // 24 % 240) + "harmless"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    lexicon = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), rows=64_000)
    stems = [t for t in lexicon.weights if not t.endswith(" ")]
    assert len(stems) > 200 and len(lexicon.exceptions) > 200
    one = toxicity.Matcher(lexicon)
    assert np.mean([one.features(f"w1 {name(k)}harmless w2")[0] == 0 for k in range(240)]) > 0.95
    assert np.mean([one.features(f"w1 {name(k)}x w2")[0] > 0 for k in range(240)]) > 0.95
    assert one.features("z" * 60)[0] > 0


def test_toxic_words_are_learned(spark):
    rnd = random.Random(2)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = [rnd.choice(clean) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[3] = rnd.choice(["grobian", "grobling", "grobheit", "schоfel", "sch0fel"])
        elif i % 7 == 0:
            words[3] = "grobskulptur"  # harmless though it begins alike
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.predict_toxicity(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in found]) > 0.97
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit("mine")), marks)
    assert kept.columns == [*docs.columns, "score"] and kept.count() < 800 and {r.score for r in kept.collect()} == {"mine"}


def test_exception_phrases_and_length():
    lexicon = toxicity.Lexicon({" grob": 3.0, " grobheit ": 5.0}, (" grobe arbeit ",), (-3.0, 2.0, 1.0))
    one = toxicity.Matcher(lexicon)
    assert one.features("eine grobe Arbeit hier") == (0, 0) and one.features("solche Grobheit")[0] == 5.0
    assert one.features("ein Grobian")[1] > one.features("ein Grobian " + "wort " * 50)[1]
    assert one.features(None) == (0.0, 0.0)


def test_exception_phrases_cover_like_all_pairs():
    rng = random.Random(4)
    words = ["ab", "abc", "abcd", "bc", "cd"]
    for _ in range(200):
        phrases = tuple({" " + " ".join(rng.choices(words, k=rng.randint(1, 4))) + " " for _ in range(rng.randint(0, 5))})
        weights = {w: rng.random() + 0.1 for w in (" ab", " abc ", " bc ", " cd ")}
        weights = {w: x for w, x in weights.items() if w not in phrases}
        text = " ".join(rng.choices(words, k=30))
        folded = toxicity.fold(text)
        places = lambda t, s=folded: [i for i in range(len(s)) if s.startswith(t, i)]
        spans = [(i, i + len(p)) for p in phrases for i in places(p)]
        longest = {i: max((len(w), x) for w, x in weights.items() if i in places(w)) for w in weights for i in places(w)}
        expected = sum(x for i, (n, x) in longest.items() if not any(a <= i and i + n <= b for a, b in spans))
        assert toxicity.Matcher(toxicity.Lexicon(weights, phrases, (0.0, 1.0, 0.0))).features(text)[0] == pytest.approx(expected)


def test_toxicity_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(0, None, None), (None, 1, 1), (3, 0, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for marks in (none, some):
        assert toxicity.predict_toxicity(empty, marks).collect() == []
        rows = toxicity.predict_toxicity(odd, marks).collect()
        assert len(rows) == odd.count() and all(r.score is not None and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_pieces_whose_hashes_meet(monkeypatch):
    from folio.llm import memo, words

    table = memo.PieceTable(lambda pieces: [list(p) for p in pieces])
    monkeypatch.setattr(words, "span_hashes", lambda data, lo, hi, which=0: np.full(len(lo), 7, np.uint64))
    data = np.frombuffer(b"abc de abc longer-than-eight x", np.uint8)
    lo, hi = words.spans(data, np.array([0, len(data)]))
    ids, sizes = table.look_up(data, lo, hi)
    assert bytes(ids.astype(np.uint8)) == b"abcdeabclonger-than-eightx" and sizes.tolist() == [3, 2, 3, 17, 1]
