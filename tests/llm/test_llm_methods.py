"""Results against brute force, round trips and held-out rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from patchlens.llm import fingerprints, language, neighbours, packing, pii, quality, secrets, sentencepieces, shards, simhash
from patchlens.llm.common import bucket, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_sentencepieces_equal_the_library(spark, docs, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = {-1: "  two  spaces \n\ttab 漢字 ﬁ é\U0001f600 x", -2: "=" * 70 + "aaaaaaaaaaaaaaaaaaaa 1234567890 ", -3: " " * 40 + "x",
           -4: "don't stop-me... http://x.y/z?q=1&b=2 ½²³ _a_b", -5: "a▁b"}
    some = {k: v[:3000] for k, v in list(texts.items())[:40]} | odd
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string").select("doc_id", F.col("text").alias("body"))
    coded = sentencepieces.encode(df, path, text="body", frequent=50, block_bytes=20_000)
    got = sentencepieces.decode(coded, path).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {k: model.encode(t) for k, t in some.items()}
    assert {r["doc_id"]: r["text"] for r in got} == {k: model.decode(model.encode(t)) for k, t in some.items()}


def test_sentencepieces_of_long_runs_and_settings(spark, monkeypatch):
    """Unbroken runs equal the library's ids whatever the memory for pairs and the broadcast share; no session setting of grouping changes."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {1: "the" * 2000, 2: "漢字" * 50 + "x", 3: "☃", 4: None, 5: "ab" * 300 + " internationalisierung", 6: "ab" * 300 + " internationalisierung"}
    monkeypatch.setattr(sentencepieces, "PAIRS", 3)
    threshold = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(threshold)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for frequent in (0, 1000):
        got = {r["doc_id"]: r["ids"] for r in sentencepieces.encode(df, path, frequent=frequent, block_bytes=1000).collect()}
        assert got == {k: model.encode(t or "") for k, t in texts.items()}
    assert spark.conf.get(threshold) == before


def jaccard(a, b):
    def shingles(t):
        w = t.lower().split()
        k = min(5, len(w))
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_near_the_truth(docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.compare_neighbours(docs).collect()}
    order = sorted(texts)
    errors = []
    for here, after in zip(order, order[1:] + order[:1]):
        t, other, r = texts[here], texts[after], got[here]
        q = len(t) // 4
        changed = t[:len(t) - q] + other[:q]
        assert r["n_chars"] == len(t) and bytes(r["edited_sha256"]) == hashlib.sha256(changed.encode()).digest()
        assert bytes(r["fingerprint"]) == fingerprints.fingerprint(t)
        errors += [r["near_edited"] - jaccard(t, changed), r["near_next"] - jaccard(t, other)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


@pytest.mark.parametrize("least,recall", [(neighbours.LEAST, 0.9), (100, 0.7)])
def test_neighbours_recall(spark, least, recall):
    df = table(spark, SF, "embeddings")
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in df.collect()}
    ids = np.array(sorted(rows))
    m = np.array([rows[i] for i in ids])
    length = np.sqrt((m * m).sum(axis=1))
    got: dict = {}
    # with the production bound this small table is searched from the root; a small one stops in the trees
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0, least=least, block_rows=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 50 == 0]:
        s = m @ rows[q] / (length * np.linalg.norm(rows[q]))
        best = [ids[k] for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        mine = sorted(got[q])
        assert [k for k, _, _ in mine] == list(range(1, len(mine) + 1))
        assert all(abs(x - s[np.searchsorted(ids, v)]) < 1e-12 for _, v, x in mine)
        hits += len(set(best) & {v for _, v, _ in mine})
    assert hits >= recall * 5 * len(got)


@pytest.mark.parametrize("n,recall", [(3000, 0.85), (12_000, 0.9)])
def test_neighbours_recall_where_the_trees_decide(spark, n, recall):
    # as on tables of millions, a two-symbol prefix holds ``least`` candidates and the root is never reached
    m = np.random.default_rng(3).normal(size=(n, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(4)
    asked = range(0, n, n // 50)
    got: dict = {}
    for r in neighbours.search(df, F.col("vec_id").isin(*asked), least=n // 1000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits = sum(len(got[q] & set(np.argsort(-(m @ m[q]))[1:6].tolist())) for q in asked)
    assert hits >= recall * 5 * len(asked)


def test_neighbours_of_copies(spark):
    rows = [(i, [1.0, 2.0]) for i in range(60)] + [(100, [2.0, 1.0]), (101, [1.0, 2.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id").isin(3, 100), trees=3)
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert [v for _, v in sorted(by[3])] == [0, 1, 2, 4, 5] and [v for _, v in sorted(by[100])] == [0, 1, 2, 3, 4]


def test_packing_whole_and_tight(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    want = {}
    for i, t in texts.items():
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), 512)):
            part = ids[s:s + 512]
            want[i, k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = packing.packed_documents(docs, path, 512).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    held: dict = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(held) <= -(-sum(x[1] for x in want.values()) // 512) + 2


def test_stored_shard_maps_are_edited(spark, docs, tmp_path):
    from patchlens.llm import queries

    rows = queries.op9_slot_shards(spark, SF).collect()
    assert len(rows) == docs.count() and {r["map_version"] for r in rows} == {1} and {r["shard"] for r in rows} <= set(range(24))
    moved = [r for r in rows if r["next_shard"] != r["shard"]]
    assert any(r["next_shard"] == 24 for r in rows) and 0 < len(moved) < len(rows) / 4
    path = str(tmp_path / "maps")
    first = {r["doc_id"]: r for r in shards.shard(docs, 4, 64, path=path).collect()}
    fewer = {r["doc_id"]: r for r in shards.shard(docs, 3, 64, path=path).collect()}
    assert {r["map_version"] for r in first.values()} == {1} and {r["map_version"] for r in fewer.values()} == {2}
    stay = [k for k, r in first.items() if r["shard"] < 3 and fewer[k]["shard"] == r["shard"]]
    assert {r["shard"] for r in fewer.values()} == {0, 1, 2} and len(stay) > len(first) / 2
    assert shards.read_map(spark, path, 1) != shards.read_map(spark, path)
    sizes = [sum(r["size"] for r in fewer.values() if r["shard"] == k) for k in range(3)]
    assert max(sizes) - min(sizes) <= 0.25 * max(sizes)


def test_ids_of_odd_strings_equal_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, ids, rng = Tokenizer.from_file(path), packing.Ids(path), random.Random(1)
    letters = [c for c in map(chr, range(0x100)) if c.isalpha()]
    texts = ["a b\u2003c\u3000d", "x\x1cy z", "hello <|endoftext|> there", "", "  lead and trail  ", "Don't stop!! ok...", "a\x85b c\u200bd\ufeffe",
             "ÀÉ ünï ½²", "\n\t\x0b\x0c\r", " q\u180ew z r", "e\u0301 É", *letters]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) + rng.choice(["", ".", "?!", ",;", "'s"]) for _ in range(5000)]
    for t in texts:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_packing_levels(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 90, 900))], "doc_id long, length long")
    got = packing.pack(df, capacity=100, group_pieces=100).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(900))
    fill: dict = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 100 and len(fill) <= sum(fill.values()) / 100 * 1.05


@pytest.mark.parametrize("lengths", [[51] * 60, ([51] + [17] * 2) * 40])
def test_packing_ends_where_lengths_fill_no_sequence(spark, monkeypatch, lengths):
    settled, levels = packing.settled, []

    def counting(df):
        levels.append(df)
        assert len(levels) < 20, "the levels go on"
        return settled(df)

    monkeypatch.setattr(packing, "settled", counting)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "id long, length long")
    got = packing.pack(df, capacity=100, group_pieces=16).collect()
    assert sorted(r["id"] for r in got) == list(range(len(lengths)))
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 100
    assert lengths.count(51) <= len(held) <= lengths.count(51) * 1.2


def test_local_search_empties_a_bin():
    sizes = np.array([60, 60, 50, 30, 40, 40, 20])  # first fit by hand leaves four bins; three hold them
    where = packing.local_search(sizes, np.array([0, 1, 2, 0, 1, 2, 3]), 100)
    assert where.max() + 1 == 3 and np.bincount(where, sizes).max() <= 100


def plain_pii(t):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 16 <= len(d) <= 19 and luhn(d) else []
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_plain_spans_equal_the_patterns(docs, texts):
    rng = random.Random(1)
    parts = ["4111 1111 1111 1111", "4111-1111", "+49 (30) ", ".1.2", "1.2.3", " ", "@a.b", "x", "@", "12345678901234567", "é", "%"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.matches(t)] == plain_pii(t)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["plain"]] for r in pii.find(docs).collect()}
    assert got == {i: plain_pii(t) for i, t in texts.items()}


@pytest.mark.parametrize("text,kind,span", [
    ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("јohn＠exаmple.com ok", "email", "јohn＠exаmple.com"),
    ("call plus four nine three zero one two three four five six", "phone", "plus four nine three zero one two three four five six"),
    ("ip one nine two dot one six eight dot one dot two five x", "ip", "one nine two dot one six eight dot one dot two five"),
    ("host １９２.168.0.1 up", "ip", "１９２.168.0.1"),
    ("pay vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins", "card", None)])
def test_pii_disguises_map_back(text, kind, span):
    (found,) = pii.spans(text)
    assert found[0] == kind and not found[3]
    assert span is None or text[found[1]:found[2]] == span


@pytest.mark.parametrize("text,span", [
    ("call plus 49 30 1234567", "plus 49 30 1234567"), ("call plus four nine 30 1234567", "plus four nine 30 1234567"),
    ('call "plus four nine three zero one two three four five"', "plus four nine three zero one two three four five"),
    ("call plu\u017f four nine \u017fix zero one two three four five", "plu\u017f four nine \u017fix zero one two three four five")])
def test_pii_finds_spelled_phones_without_other_hints(text, span):
    assert [(k, text[a:b]) for k, a, b, _ in pii.spans(text)] == [("phone", span)]


def test_pii_gate_refuses_only_what_stays(monkeypatch):
    rng = random.Random(2)
    parts = ["plus", "surplus", "Plus", "four", "Nine", "un", "neuf", "z\u00e9ro", "7", "49", "dot", "po\u0131nt", "[at]", "( \u017f)", "at", "x", '"', "(", "\u017fix",
             "s\u0130x", "-", "\t", ",", "example", "@"]
    texts = [rng.choice(" -").join(rng.choice(parts) + rng.choice(["", "", "", '"', ")"]) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    refused = [t for t in texts if not pii._disguised(t)]
    assert 100 < len(refused)
    monkeypatch.setattr(pii, "_disguised", lambda t: True)
    folds = re.compile(pii._FOLDABLE)
    assert [t for t in refused if not folds.search(t) and pii.normalised(t) is not None] == []


@pytest.mark.parametrize("whole,kind", [
    ("j\u043ehn@example.com", "email"), ("10.0.0.1\uff12", "ip"), ("john@mail.ex\u0430mple.com", "email"),
    ("john@mail.example [dot] com", "email"), ("+49 30 1234567 eight nine two one", "phone")])
def test_pii_names_the_whole_of_a_half_disguised_identifier(whole, kind):
    text = f"see {whole}, thanks"
    found = pii.spans(text)
    assert sorted(plain for *_, plain in found) == [False, True]
    assert [(k, text[a:b]) for k, a, b, plain in found if not plain] == [(kind, whole)]
    assert pii.masked(text, found) == f"see [{kind.upper()}], thanks"
    assert pii.spans("a@b.de and four nine three zero") == [("email", 0, 6, True)]


def test_pii_leaves_prose_alone():
    for t in ("Meet me at noon on the dot.", "un deux trois, nous irons au bois", "one two three four", "price 12 345 678", "a dot b at c"):
        assert pii.spans(t) == []
    assert pii.masked("a b@c.de f", pii.spans("a b@c.de f")) == "a [EMAIL] f"


def plain_secrets(t):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        out += [(m.start(), 0, m.end(), "assign")] if len(m[2]) >= 12 else []
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [(k, a, b) for a, _, b, k in sorted(out)]


def test_secrets_equal_the_patterns_and_add_random_tokens(spark, docs, texts):
    rng = random.Random(2)
    parts = ["password", "token", "=", ": ", "'", "AKIA", "ABCDEFGH12345678", "deadbeef01", "0123456789abcdef", " ", "é", "secret", "Api_Key", "x" * 11]
    made = {1000 + k: "".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for k in range(400)}
    token = "".join(random.Random(3).choice(secrets.ALPHABET[:62]) for _ in range(40))
    made[5000] = f"see {token} there and internationalizationconfiguration too"
    df = spark.createDataFrame(list((texts | made).items()), "doc_id long, text string")
    model = secrets.fit(df)
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.find(df, model).collect()}
    for i, t in (texts | made).items():
        assert [s for s in got[i] if s[0] != "random"] == plain_secrets(t), t
    assert got[5000] == [("random", 4, 44)]
    assert not [i for i in texts if any(s[0] == "random" for s in got[i])]


def test_language_held_out(spark, docs):
    model = language.fit(docs, lambda k: bucket(k, 5) != 0)
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(bucket(F.col("doc_id"), 5) == 0).collect()
    assert got and np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, "12 34 !"), (3, "Der Hund und die Katze")], "doc_id long, text string")
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()}
    assert by[1] == by[2] == ("und", 0.0) and by[3][0] == "de"


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels, lambda k: bucket(k, 4) != 2)
    held = quality.score(docs, model).join(labels, "doc_id").where(bucket(F.col("doc_id"), 4) == 2).collect()
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.9
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.9


def test_shards_even_whole_and_stable(spark, docs, texts, tmp_path):
    got = shards.shard(docs, 24).collect()
    load, places = {}, {}
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        places.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(texts) and max(load.values()) <= max(1.1 * sum(load.values()) / 24, max(r["size"] for r in got))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    records = shards.with_slots(docs, slots=64)
    totals = shards.slot_totals(records)
    first = shards.first_map(totals, 4, 64)
    grown = shards.rebalanced(first, totals, 5)
    path = str(tmp_path / "map")
    shards.write_map(spark, first, path)
    shards.write_map(spark, grown, path)
    assert shards.read_map(spark, path) == grown and shards.read_map(spark, path, 1) == first
    moved = [(a, b) for a, b in zip(first, grown) if a[1] != b[1]]
    assert moved and len(moved) < 32 and {r[1] for r in shards.rebalanced(grown, totals, 3)} == {0, 1, 2}


def test_simhash_components(spark, docs, texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def brute(t):
        w = re.findall("[^\x20\x09-\x0D]+", t.translate(low))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[k:k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    want = {i: brute(t) for i, t in texts.items()}
    group = {i: i for i in want}
    for i in sorted(want):
        for j in sorted(want):
            if i < j and (want[i] ^ want[j]).bit_count() <= 4 and group[i] != group[j]:
                low_, high = sorted((group[i], group[j]))
                group = {k: low_ if g == high else g for k, g in group.items()}
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs, 4, 4).collect()}
    assert got == {i: (want[i], group[i]) for i in want}


@pytest.mark.parametrize("ring,bits", [(3, 4), (5, 4), (3, 2)])
def test_pigeonring_loses_no_pair(spark, ring, bits):
    rng = random.Random(ring)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(6)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits, ring).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= bits}


def test_components_of_a_chain(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100}
