"""Operators 11, 12 and 13."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from oracle import compare
from pyspark.sql import functions as F

from folio.llm import codes, pieces, trie
from folio.llm import queries as numbered

# --- 11 ------------------------------------------------------------------------


def brute_trie(rows):
    """Nodes by the contract's words, with plain dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    out = []
    for node, ids in members.items():
        below = [m for m in members if m[: len(node)] == node]
        childless = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        ends = ",".join(str(c) for c in ids if made[c] == node)
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        out.append((ids[0], len(node), members[node[:-1]][0] if node else None, len(ids), sum(len(m) == len(node) + 1 for m in below), len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


SCHEMA = "conv_id long, turn long, role string, text string"


def nodes(df, **options):
    found = trie.prefix_trie(df, **options)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_trie_of_shared_turns(spark):
    draw = random.Random(5)
    rows = []
    for c in [*range(40), *range(100, 140), *range(250, 275), 1031, 2500, 2501]:
        for turn in range(draw.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn or None, draw.choice(["user", "assistant", None]), draw.choice(["a", "bé", "\U0001f600x", "", None])))
    rows += [(7, 40 + i, "user", "long") for i in range(60)] + [(None, 0, "user", "x"), (None, 1, "user", "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute_trie(rows)
    for heavy in (1, 4, 1000):
        assert nodes(df, heavy=heavy) == want


def test_trie_of_a_hot_conversation_and_a_hot_first_turn(spark):
    rows = [(c, t, "user", f"the same {t}") for c in range(0, 3000, 100) for t in range(3)]
    rows += [(c, 0, "user", "first") for c in range(5000, 5040)] + [(c, 1, "user", f"then {c}") for c in range(5000, 5040)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert nodes(df, heavy=5) == brute_trie(rows)


def test_trie_of_many_equal_conversations_hashes_ids_in_order(spark):
    df = spark.range(0, 600_000, 100).selectExpr("id as conv_id", "0L as turn", "'user' as role", "'hello' as text")
    found = trie.prefix_trie(df).where("depth = 1").first()
    assert found.n_convs == 6000 and found.saved_tokens == 5999 * 5
    assert found.ends_sha256 == hashlib.sha256(",".join(str(c) for c in range(0, 600_000, 100)).encode()).hexdigest()


def test_trie_of_one_long_conversation(spark):
    df = spark.range(20_000).selectExpr("300L as conv_id", "id as turn", "'user' as role", "cast(id % 7 as string) as text", "1 as Conv_Id2", "2 as `a.b`")
    found = trie.prefix_trie(df)
    assert found.agg(F.max("depth"), F.count("*"), F.sum("n_leaves"), F.sum("saved_tokens")).first() == (20_000, 20_001, 20_001, 0)


def test_trie_of_odd_tables(spark):
    assert nodes(spark.createDataFrame([], SCHEMA)) == []
    assert nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
    # conversation 101 has h turns at most and no base: turnless, a member of the root alone
    lonely = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    assert nodes(spark.createDataFrame([(lonely, 0, "user", "x")], SCHEMA)) == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]
    twice = [(300, 0, "user", "x")] * 2 + [(300, None, None, None)] * 2
    assert nodes(spark.createDataFrame(twice, SCHEMA)) == brute_trie(twice)


def test_bitvector_gives_parents_children_and_sums():
    place = np.array([1, 1, 2, 2, 2, 4])  # the last stands under the root: its parent is elsewhere
    found = trie.Louds(place, np.array([5, 3, 9, 8, 7, 6]), np.array([0, 0, 3, 5, 3, 1]))
    assert found.bits.astype(int).tolist() == [1, 1, 1, 0, 1, 1, 0, 1, 0, 0, 0, 0, 0]
    assert found.node.tolist() == [2, 1, 4, 5, 3, 6]
    assert found.parents().tolist() == [0, 0, 0, 1, 1, 2, 0] and found.children().tolist() == [3, 2, 1, 0, 0, 0, 0]
    assert found.add_up(np.arange(7)).tolist() == [21, 8, 7, 3, 4, 5, 6]


# --- 12 ------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def agree(texts, library):
    found, ids, at = pieces.encode_batch(pa.array(texts, pa.string()), MODEL)
    want = library.encode([t or "" for t in texts])
    for i in range(len(texts)):
        own = ids[at[i] : at[i + 1]]
        assert own.tolist() == want[i], texts[i]
        assert found.decode(own).decode() == library.decode(want[i])


ODD = [None, "", " ", "  ", "   a", "▁▁x▁", "<s>hello</s><0x41><unk>", "\n\n\t x\r\n", "a\0b", "日本語テスト", "😀 👨‍👩‍👧", " 　a b", "x" * 300, "don’t “quote” — …", " trailing ", "Áe", "�‮", " " * 40 + "x" + " " * 17 + "the"]


def test_pieces_equal_the_library(library):
    agree(ODD, library)
    agree([" " * n + tail for n in range(1, 80) for tail in ("", "a")], library)
    draw = random.Random(3)
    agree(["".join(draw.choice("aetoinshr  .,\né▁日") for _ in range(draw.randint(0, 60))) for _ in range(600)], library)
    texts = pieces.coder(MODEL)[0].texts
    agree(["".join(draw.choice(texts[259:]) for _ in range(draw.randint(1, 20))) for _ in range(600)], library)


def test_pieces_of_very_long_words(library):
    agree(["ab" * 100_000, "the" * 50_000, "é" * 30_000], library)


def test_decoding_of_any_ids(library):
    found, draw = pieces.coder(MODEL)[0], random.Random(8)
    for _ in range(800):
        ids = [draw.randrange(0, 300) if draw.random() < 0.5 else draw.randrange(32_000) for _ in range(draw.randint(0, 12))]
        assert found.decode(np.array(ids, np.int64)).decode("utf-8", "replace") == library.decode(ids)


def test_neighbours_tell_merged_sequences():
    found = pieces.coder(MODEL)[0]
    for word in ("hello", " unbelievably", "international", "abababab"):
        parts = found.parts(word)
        assert parts == found.merged(word)
        assert all(found.fits(a, b) for a, b in zip(["", *parts], parts))


def test_piece_table_tells_equal_hashes_apart(monkeypatch):
    from folio.llm import memo, words

    monkeypatch.setattr(words, "span_hashes", lambda data, lo, hi, which=0: np.full(len(lo), 7, np.uint64))
    data = np.frombuffer(b"abcdefghXabcdefghYabcdefghXlonger", np.uint8)
    lo, hi = np.array([0, 9, 18, 27]), np.array([9, 18, 27, 33])
    ids, sizes = memo.PieceTable(lambda parts: [[p[-1], len(p)] for p in parts], whole=True).look_up(data, lo, hi)
    assert ids.tolist() == [ord("X"), 9, ord("Y"), 9, ord("X"), 9, ord("r"), 6] and sizes.tolist() == [2] * 4


def test_piece_operators(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, `A.b` string")
    rows = pieces.piece_decode(pieces.piece_encode(df, MODEL), MODEL).orderBy("doc_id").collect()
    assert [r.token_ids for r in rows] == library.encode([t or "" for t in ODD])
    assert [r.decoded for r in rows] == [(t or "").replace("▁", " ") for t in ODD]
    assert pieces.piece_decode(spark.sql("select cast(null as array<int>) as token_ids"), MODEL).first().decoded is None
    empty = pieces.piece_digest(df.limit(0), MODEL)
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "A.b", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_piece_query(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in numbered.op12_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for d in docs:
        ids = library.encode(d.text or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert tuple(rows[d.doc_id])[1:] == want
    assert len(rows) == len(docs)


# --- 13 ------------------------------------------------------------------------


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Codes in Python integers; rows are (vec_id, vector, label), ids distinct."""
    kept = []
    for c, v, label in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((c, [int(np.floor(1024 * float(x))) for x in v], label))
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    cut = [[(v + [0] * width * parts)[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for x in cut:
                groups[nearest(x[p], books[p])[1]].append(x[p])
            for k, own in groups.items():
                books[p][k] = [sum(col) // len(own) for col in zip(*own)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for (c, _, label), x in zip(kept, cut):
        found = [nearest(x[p], books[p]) for p in range(parts)]
        error = min(sum(f for f, _ in found), 2**63 - 1)
        by_label[label] += error
        out.append((c, "".join(f"{k:02x}" for _, k in found), error, label))
    return sorted(((c, code, e, min(by_label[label], 2**63 - 1), digest) for c, code, e, label in out), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int"


def coded(df, **options):
    return sorted((tuple(r) for r in codes.compress(df, **options).collect()), key=repr)


def test_codes_of_clustered_vectors(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + draw.normal(scale=0.05, size=8)).tolist(), [None, 1, 2][i % 3]) for i in range(300)]
    rows += [(1000 + i, rows[5][1], 7) for i in range(150)]  # a vector that a third of the rows share
    rows += [(5000, None, 1), (5001, [1.0, None, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], 1), (5002, [float("nan")] * 8, 1), (5003, [float("inf")] * 8, 1), (5004, [0.0] * 8, None)]
    df = spark.createDataFrame(rows, VECTORS).repartition(6)
    assert coded(df, entries=16) == brute_codes(rows, entries=16)


def test_codes_break_ties_low_and_keep_unused_entries(spark):
    rows = [(i, [float(v)] * 4, 1) for i, v in enumerate([1, 1, 3, 2, 2])]  # equal entries; 2 lies between 1 and 3
    assert coded(spark.createDataFrame(rows, VECTORS), entries=3) == brute_codes(rows, entries=3)


def test_codes_of_odd_tables(spark):
    assert coded(spark.createDataFrame([], VECTORS)) == []
    assert coded(spark.createDataFrame([(1, None, 2)], VECTORS)) == []
    assert coded(spark.createDataFrame([(1, [], 2)], VECTORS))[0][1:4] == ("00000000", 0, 0)
    mixed = [(3, [0.5], 1), (None, [0.1, 0.2, 0.3, 0.4, 0.5], None), (4, [-0.001] * 7, None)]
    assert coded(spark.createDataFrame(mixed, VECTORS), entries=2) == brute_codes(mixed, entries=2)
    wide = [(i, [10.0 ** (i % 14), -(3.0**i), 1.0, 0.0], i % 2) for i in range(20)]
    assert coded(spark.createDataFrame(wide, VECTORS), entries=3) == brute_codes(wide, entries=3)
    huge = codes.compress(spark.createDataFrame([(1, [1e300] * 4, 1), (2, [-1e300] * 4, 1), (3, [0.0] * 4, 1)], VECTORS), entries=1).collect()
    assert len(huge) == 3 and all(r.error >= 0 for r in huge)
    repeated = spark.createDataFrame([(1, [0.5] * 4, 1)] * 3, VECTORS).withColumn("Vec_Id2", F.lit(1)).withColumn("a.b", F.lit(2))
    assert len(coded(repeated)) == 3


def test_hot_keys_are_joined_by_broadcast(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 2 = 0, null, if(id % 3 = 0, 1, id)) as k")
    counted = rows.groupBy("k").agg(F.count("*").alias("n_rows"), F.sum("id").alias("total"))
    got = codes.join_counted(rows, counted, ["k"], 5000, share=100)
    assert got.count() == 5000 and got.where("k is null").select("total").distinct().count() == 1
    assert got.where("total is null").count() == 0


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_vector_codes"])
def test_matches_sql(spark, name):
    got, want = compare(spark, "/root/testdata/sf0.01", numbered.queries()[name], numbered.oracle_sql()[name])
    assert got == want
