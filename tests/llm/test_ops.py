"""Operators against plain versions; nulls, empty and long texts, ties, repeats, empty tables, foreign columns."""

import hashlib
import json
import random
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineloom.llm import chat, decontaminate, licenses, neardup, packing, quality, search, secrets, sharding, toxicity
from lineloom.llm.packing import vocabulary_path

from . import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, h long, label int, a long"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, 2, 3, 4) for i, t in zip(ids, texts, strict=True)], DOC).repartition(3)


def prose(rng, n, words=None):
    words = words or ["".join(rng.choices(["th", "er", "on", "an", "re", "he", "in", "ed"], k=rng.randint(1, 4))) for _ in range(400)]
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    near = [b.replace(" ", "  ", 1) for b in base[:10]] + [b + " more" for b in base[:25]] + [" ".join(["tail", *base[3].split()[i:]]) for i in range(12)]
    return [*base, *near, base[0], base[0], None, "", " \n\t", "one", "Two words", "ÄÖ ß é", "x" * 50_000, prose(rng, 20_000)]


# SimHash ----------------------------------------------------------------------------------------


def test_fingerprints(corpus):
    assert [neardup.fingerprint(t) for t in corpus] == [brute.fingerprint(t) for t in corpus]


def test_components_against_all_pairs(spark, corpus):
    rng = random.Random(1)
    fps = {i: brute.fingerprint(t) for i, t in enumerate(corpus)}
    want = {k: min(g) for g in brute.components(fps) for k in g}
    got = neardup.near_duplicates(documents(spark, corpus)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(corpus)
    # chains of single flips around one value, and a crowded neighbourhood
    value, chain = 0x0123456789ABCDEF, []
    for _ in range(40):
        value ^= 1 << rng.randrange(64)
        chain.append(value)
    crowd = [0xF0F0F0F0F0F0F0F0 ^ sum(1 << k for k in rng.sample(range(16), rng.randint(0, 16))) for _ in range(400)]
    values = dict(enumerate([*chain, *crowd, 0, (1 << 64) - 1, (1 << 64) - 4]))
    df = spark.createDataFrame([(i, v - (1 << 64) if v >> 63 else v) for i, v in values.items()], "doc_id long, fp long")
    got = {r["fp"] % (1 << 64): r["component_id"] for r in neardup.classes(df).collect()}
    want = {values[k]: min(g) for g in brute.components(values) for k in g}
    assert got == want


def test_long_posting_lists():
    rng = random.Random(2)
    low = np.unique(np.array([0xAB00 << 32 | rng.randrange(1 << 16) for _ in range(3000)], np.int64))
    groups = brute.components({int(x): int(x) for x in low[:800]})
    up = {int(x): int(x) for x in low[:800]}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    assert len(list(neardup.short_lists(low[:800].view(np.uint64), np.arange(800), [255, 255 << 8, 255 << 40], 2))) > 100
    for a, b in neardup.list_links(low[:800], 2, (0, 1, 5)):
        assert (a ^ b).bit_count() <= 2
        up[root(a)] = root(b)
    assert {frozenset(g) for g in groups} == {frozenset(x for x in up if root(x) == r) for r in {root(x) for x in up}}


def test_the_count_filter_decides():
    # Any two bytes that differ are left out by one choice, and no choice leaves out most bytes.
    left_out = neardup.choices(2)
    assert all(any({a, b} <= set(c) for c in left_out) for a in range(8) for b in range(8)) and {len(c) for c in left_out} == {3}
    # Of pairs that meet in a list, some fall short of the tally and some of the verification.
    a, three, two_bytes, near = 0, 0x010101, 0x0303, 0x0101
    u = np.array([a, three, two_bytes, near], np.uint64)
    x = u[0] ^ u
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
    assert shared.tolist() == [8, 5, 6, 6]
    i, j = neardup.tallied(u, 2)
    assert set(zip(i.tolist(), j.tolist())) == {(0, 3), (1, 3), (2, 3)}


def test_hot_fingerprint(spark):
    # Nine rows in ten are one text; the neighbourhood of another is crowded.
    values = [5] * 900 + [0xFF00 ^ (1 << k) for k in range(50)] + [0xFF00]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in neardup.classes(df).collect()}
    assert len(got) == 52 and got[5] == 0 and {c for f, c in got.items() if f != 5} == {900}


def test_one_of_each(spark, corpus):
    df = documents(spark, [*corpus, corpus[0]], [*range(len(corpus)), 0])
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    assert neardup.one_of_each(df.withColumn("__h", F.lit("mine"))).filter("__h <> 'mine'").count() == 0
    rows = kept.collect()
    fps = {i: brute.fingerprint(t) for i, t in enumerate(corpus)}
    assert sorted(r["doc_id"] for r in rows) == sorted(min(g) for g in brute.components(fps))
    assert neardup.one_of_each(df.limit(0)).count() == 0


# decontamination --------------------------------------------------------------------------------


def test_wu_manber(spark):
    rng = random.Random(3)
    words = ["a", "b", "ab", "ba", "é", "x1"]
    items = [(i, prose(rng, rng.randint(0, 14), words)) for i in range(60)] + [(100, None), (101, "---"), (7, "q"), (8, "Q r")]
    texts = [prose(rng, rng.randint(0, 60), words) for _ in range(120)] + [None, "", "!!", items[5][1] + " " + items[6][1], "Q! R q", prose(rng, 5000, words)]
    got = [(n, int(h.sum()), len(i), decontaminate_digest(i), len(i) >= 2) for n, h, i in decontaminate.Matcher([(str(a), b) for a, b in items]).search(texts)]
    assert got == brute.hits(texts, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.hits(texts, items)
    plans = []
    for limit in (decontaminate.BLOCK_BYTES, 300, 100):
        out = decontaminate.scan(documents(spark, [*texts, texts[-1]], [*range(len(texts)), 0]).withColumnRenamed("h", "found"), bench, ["doc_id", "found"], limit=limit)
        assert out.columns == ["doc_id", "found", "found_"]
        plans.append(out._jdf.queryExecution().analyzed().toString().count("MapInArrow"))
        rows = [(r["doc_id"], (r["found_"]["n_words"], r["found_"]["n_hit"], len(r["found_"]["items"]), decontaminate_digest(r["found_"]["items"]))) for r in out.collect()]
        assert sorted(rows) == sorted([*((i, w[:4]) for i, w in enumerate(want)), (0, want[-1][:4])])
        if limit == 300:
            kept = decontaminate.clean(documents(spark, texts), bench)
            assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, w in enumerate(want) if w[2] == 0]
    assert plans == [1, 2, 2]
    rows = decontaminate.report(documents(spark, texts), bench).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == dict(enumerate(want))
    assert decontaminate.report(documents(spark, texts), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.report(documents(spark, texts).limit(0), bench).count() == 0


def test_one_block_at_a_time(spark, monkeypatch):
    held, most, real = set(), [], decontaminate.blocks_of

    class Block(tuple):
        def __del__(self):
            held.discard(id(self))

        def __reduce__(self):
            return tuple, (tuple(list(self)),)

    def blocks(benchmark, limit):
        for b in real(benchmark, limit):
            block = Block(b)
            held.add(id(block))
            most.append(len(held))
            yield block
            del block

    monkeypatch.setattr(decontaminate, "blocks_of", blocks)
    rng = random.Random(13)
    bench = spark.createDataFrame([(i, prose(rng, 20)) for i in range(40)], "item_id long, text string")
    decontaminate.scan(documents(spark, [prose(rng, 50)]), bench, ["doc_id"], limit=200).collect()
    # The one that is searched and the one that is read.
    assert len(most) > 5 and max(most) <= 3


def decontaminate_digest(items):
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


# packing ----------------------------------------------------------------------------------------


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    texts = [*corpus, "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "Straße's don't it's,' <|endoftext|> á ΑΣ ΣΑΣ. İstanbul x² \x0b\x1c y"]
    ids = [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]
    assert ids[len(corpus)] == [49407, 1]
    rows = packing.pack(documents(spark, texts), vocabulary_path(), with_ids=True).collect()
    seen, windows = Counter(), {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert part == r["ids"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r["doc_id"]] += r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in enumerate(ids)}
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(documents(spark, texts).limit(0), vocabulary_path()).count() == 0


def test_best_fit():
    rng = random.Random(4)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    at, offset = packing.pack_lengths(sizes, 100)
    free, want = [], {}
    for i in sorted(range(300), key=lambda i: (-sizes[i], i)):
        fits = [(f, k) for k, f in enumerate(free) if f >= sizes[i]]
        best = min(fits, default=None)
        if best is None:
            free.append(100 - sizes[i])
        else:
            free[best[1]] -= sizes[i]
    assert max(at) + 1 == len(free)
    for k in range(len(free)):
        mine = sorted((int(offset[i]), sizes[i]) for i in range(300) if at[i] == k)
        assert [o for o, _ in mine] == [sum(s for _, s in mine[:j]) for j in range(len(mine))]
    with pytest.raises(ValueError):
        packing.pack_lengths([0])


# sharding ---------------------------------------------------------------------------------------


def test_sharding(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("shard")).unionByName(spark.createDataFrame([(None, 1)] * 500, "doc_id long, shard int"))
    now = sharding.shard(df, "doc_id", [1.0] * 8)
    grown = sharding.shard(now, "doc_id", [1.0] * 9, "grown")
    rows = grown.collect()
    assert all(r["grown"] in (r["shard"], 8) for r in rows)
    counts = Counter(r["shard"] for r in rows if r["doc_id"] is not None)
    assert len(counts) == 8 and min(counts.values()) > 400
    heavy = Counter(r["shard"] for r in sharding.shard(df.filter("doc_id is not null"), "doc_id", [3.0, 1.0]).collect())
    assert 2.5 < heavy[0] / heavy[1] < 3.6
    # One key, null here, may hold most rows; columns may have any name.
    hot = now.unionByName(now.filter("doc_id is null").crossJoin(spark.range(20)).select("doc_id", "shard")).withColumn("__place", F.lit(1)).withColumn("__start", F.lit("x"))
    slots = sharding.with_slots(hot.repartition(5), "shard")
    assert slots.columns == ["doc_id", "shard", "__place", "__start", "slot"]
    slots = slots.collect()
    for s in range(8):
        mine = sorted(r["slot"] for r in slots if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert len(slots) == 14500 and sharding.with_slots(now.limit(0), "shard").count() == 0


# classifiers ------------------------------------------------------------------------------------


def auc(pairs):
    good = [s for s, y in pairs if y]
    bad = [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def junk(rng):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join([prose(rng, 1)] * rng.randint(50, 200))
    return " ".join(w.upper() + "!!" if kind == 1 else w + rng.choice(["***", "$$$"]) for w in prose(rng, rng.randint(50, 200)).split())


def test_quality(spark):
    rng = random.Random(6)
    texts = [junk(rng) if i % 5 == 0 else prose(rng, rng.randint(30, 300)) for i in range(500)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(500)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    df = documents(spark, texts)
    model = quality.fit(df, labels, F.col("doc_id") % 2 == 0)
    rows = quality.score_documents(df, model).collect()
    assert len(rows) == 502 and all(0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], r["doc_id"] % 5 > 0) for r in rows if r["doc_id"] % 2 and r["doc_id"] < 500]
    assert auc(held) > 0.98
    assert {r["predicted"] == (r["score"] >= 0.3) for r in rows} == {True}
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["predicted"]}
    blank = quality.fit(df, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score_documents(df, blank).collect()} == {0.5}
    one = quality.fit(df, labels.filter("quality = 1"), F.lit(True))
    assert {r["score"] for r in quality.score_documents(df, one).collect()} == {1.0}
    assert quality.score_documents(df.limit(0), model).count() == 0


def test_isotonic():
    knots, values = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([2.0, 2, 2, 2]), np.array([0.0, 2, 1, 2]))
    assert (np.diff(values) >= 0).all() and len(values) == 3 and (np.diff(knots) > 0).all()


def test_toxicity(spark):
    rng = random.Random(7)
    texts = []
    for i in range(600):
        t = prose(rng, rng.randint(20, 200))
        if i % 6 == 0:
            t += " " + rng.choice(["grobian", "lump"]) if rng.random() < 0.5 else " ekl" + rng.choice(["ige", "iger", "iges", "em", "en"])
        texts.append(t)
    texts += [None, "", "grobian"]
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    df = documents(spark, texts)
    rows = toxicity.score_documents(df, toxicity.fit(df, labels, F.col("doc_id") % 4 != 2)).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 603 and auc([(got[i]["score"], i % 6 == 0) for i in range(600) if i % 4 == 2]) > 0.98
    assert got[602]["predicted"] == 1 and got[600]["predicted"] == got[601]["predicted"] == 0
    assert {r["score"] for r in toxicity.score_documents(df, toxicity.fit(df, labels.limit(0), F.lit(True))).collect()} == {0.5}


def test_label_model_learns_from_votes_alone():
    rng = np.random.default_rng(8)
    y = rng.random(6000) < 0.2
    good = [rng.random(6000) < np.where(y, 0.5, 0.01) for _ in range(5)]
    noise = [rng.random(6000) < 0.04 for _ in range(3)]
    copy = [noise[0], noise[0]]
    votes = np.array([*good, *noise, *copy]).T.astype(np.uint8)
    model = toxicity.label_model(votes, 0.2)
    p, accuracy = model.posterior(votes), model.accuracy(votes)
    real = np.array([y[v > 0].mean() for v in votes.T])
    assert accuracy[:5].min() > accuracy[5:].max() + 0.2 and abs(accuracy[:5] - real[:5]).mean() < 0.15
    # Three voters that are one are tied to each other, and only one of them adds evidence.
    tied = [j for j in (5, 8, 9) if model.parent[j] in (5, 8, 9)]
    assert len(tied) == 2 and model.evidence[1, tied].max() < 0.1
    fired, majority = votes.any(1), votes.sum(1) > 0
    assert ((p > 0.5) == y)[fired].mean() > (majority == y)[fired].mean() + 0.1
    assert (p[~fired] < 0.2).all()


def test_many_documents_of_one_id(spark):
    rng = random.Random(14)
    texts = [prose(rng, 30) + (" grobian" if i % 4 == 0 else "") for i in range(200)]
    df = documents(spark, [*texts, *[f"{t} x{k}" for k in range(30) for t in texts]], [*range(200), *[0] * 6000])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(0, 1, 1)] * 50, "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(df, labels, F.lit(True), 1000).count() <= 200
    model = toxicity.fit(df, labels, F.lit(True))
    assert "grobian" in model.terms and toxicity.score_documents(df, model).count() == 6200
    assert quality.score_documents(df, quality.fit(df, labels, F.lit(True))).count() == 6200


def test_quality_against_plain_equations(spark):
    rng = random.Random(15)
    texts = [junk(rng) if i % 3 == 0 else prose(rng, rng.randint(5, 200)) for i in range(240)] + ["x" * 50_000]
    labels = spark.createDataFrame([(i, int(i % 3 > 0 or i % 30 == 0), 0) for i in range(241)], "doc_id long, quality int, toxic int")
    df = documents(spark, texts)
    model = quality.fit(df, labels, F.lit(True))
    stats = np.array([quality.statistics(t) for t in texts])
    y = np.array([float(i % 3 > 0 or i % 30 == 0) for i in range(241)])
    sd = stats.std(0)
    phi = quality.lift(stats, stats.mean(0), np.where(sd > 1e-9, sd, 1.0))
    ridge = quality.RIDGE * np.eye(phi.shape[1])
    ridge[0, 0] = 1e-6
    raw = phi @ np.linalg.solve(phi.T @ phi + ridge, phi.T @ y)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(df, model).collect()}
    want = np.clip(np.interp(raw, model.knots, model.values), 0, 1)
    assert np.abs(np.array([got[i] for i in range(241)]) - want).max() < 1e-6
    assert (np.diff(model.values) >= 0).all()


# secrets ----------------------------------------------------------------------------------------


def test_secrets(spark):
    rng = random.Random(9)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(60)]
    texts = [None, "", "token=token = abcdefgh", "passWORD: 'abc123.x' Secret=short", "AKIA" + "Z" * 15, "AKIA" + "Z" * 16 + "AKIA" + "Z" * 16, "deadbeef" * 3, "ſecret=abcdefgh", "API_KEY = \"aaaaaa\" apikey:bbbbbb", "a" * 24]
    texts += [prose(rng, 20) + f' token = "{h}" ' + prose(rng, 20) for h in hexes[:40]] + [f"see {h} there" for h in hexes[40:]]
    texts += ["plain " + "".join(rng.choices("0123456789abcdef", k=18)) + " x", "ghp_" + "".join(rng.choices(string.ascii_letters + string.digits, k=36)), "thequickbrownfoxjumpsover 1234567890123456"]
    for t in texts:
        assert secrets.base_spans(t) == brute.secrets(t)
    df = documents(spark, texts)
    model = secrets.fit(df)
    rows = {r["doc_id"]: r for r in secrets.report(df, model).collect()}
    for i, t in enumerate(texts):
        base = brute.secrets(t)
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(rows[i]["spans"].split(","))
        assert rows[i]["n_hex"] == sum(k == "hex" for k, _, _ in base)
    assert "learned" in rows[len(texts) - 2]["spans"] and rows[len(texts) - 1]["spans"] == ""
    assert all(len(r["likelihoods"]) == r["spans"].count("learned") and min(r["likelihoods"], default=99) > secrets.PRIOR for r in rows.values())
    out = {r["doc_id"]: r["text"] for r in secrets.redact(df, model).collect()}
    assert out[0] is None and out[1] == "" and hexes[3] not in out[13] and "[secret]" in out[13]
    assert secrets.report(df.limit(0), model).count() == 0
    twice = secrets.report(documents(spark, [texts[13]] * 2, [4, 4]), model).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    long = secrets.report(documents(spark, ["a.b" * 20_000 + " " + texts[-2]]), model).first()
    assert long["spans"] == f"learned:60001:{60001 + 40}"
    assert secrets.fit(df.limit(0)).learned(texts[-2])


def test_automaton():
    rng = random.Random(10)
    m = secrets.Automaton(["key-" + "".join(rng.choices("0123456789", k=12)) for _ in range(200)])
    spelt = [t for t in ("key-987654321098", "key-98765432109x", "kez-987654321098", "key-98765432109", "key-9876543210987") if m.likelihood(t) > -np.inf]
    assert spelt == ["key-987654321098"]
    assert m.states == 17 and m.shortest == 16 and m.beginning == "key-"
    # The likelihoods of all tokens that a small automaton spells add up to one.
    small = secrets.Automaton([a + b for a in "01" for b in "ab" for _ in range(20)])
    total = sum(np.exp(small.likelihood(a + b)) for a in string.printable for b in string.printable)
    assert abs(total - 1) < 1e-6
    # Two forms of unequal futures stay apart.
    two = secrets.Automaton(["a" + "".join(rng.choices("0123456789", k=6)) for _ in range(100)] + ["g" + "".join(rng.choices("ABCDEF", k=6)) for _ in range(100)])
    assert two.likelihood("a123456") > -30 and two.likelihood("aABCDEF") < two.likelihood("gABCDEF") - 10


# chat -------------------------------------------------------------------------------------------


def test_escape_round_trip():
    for t in ["", "[INST]", "</s>[INST] ok [/INST]", r"[\INST] [\\/INST] <\s>", "[IMG 0]", "[TURN x]", "a < b [x]"]:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not chat._MARK.search(e)


def test_chat(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "[/ANS] ok"), (1, 2, "tool ]x", None), (2, None, None, "a"), (2, 5, "assistant", "b"), (2, 5, "assistant", "b"), (None, 0, "assistant", "ü"), (3, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1)).repartition(3)
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    for c in got:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    whole = "".join(r["piece"] for r in chat.formatted(df).filter("conv_id = 1").orderBy("n").collect())
    assert whole.startswith("<s>[INST]") and whole.endswith("</s>") and whole.count("</s>") == 1 and len(whole) == got[1]["formatted_chars"]
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_parts(spark):
    parts = [{"type": "text", "text": "look [IM"}, {"type": "text", "text": "G 0]"}, {"type": "image", "ref": "a.png", "width": 56, "height": 29}, {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "document", "pages": 2}]
    df = spark.createDataFrame([(1, 0, "user", [{k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.formatted(df).first()
    assert r["piece"] == r"<s>[INST]look [\IMG 0][IMG 0][AUDIO 1][DOC 2][/INST]</s>" and r["refs"] == ["a.png", "b.wav", ""] and r["n_attachments"] == 3
    assert r["tokens"] == 2 + 2 + 4 + 38 + 1024


# search -----------------------------------------------------------------------------------------


def test_search(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 16))
    x[500:900] = x[100]  # a crowd of equal vectors
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0] * 3), (None, [1.0] * 16), (9400, [None] * 16), (9500, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(3)
    got = {}
    for r in search.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 100))
    right = 0
    for q, found in got.items():
        d = np.sqrt(np.square(x - x[q]).sum(1))
        want = sorted((d[i], i) for i in range(3000) if i != q)[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [(f[2], f[1]) for f in found] == sorted((f[2], f[1]) for f in found)
        assert all(abs(f[2] - d[f[1]]) < 1e-12 for f in found)
        right += len({i for _, i in want} & {f[1] for f in found})
        if q == 100:
            assert [f[1] for f in found] == list(range(500, 510))
    assert right / (10 * len(got)) >= 0.95
    # Query blocks do not change the answer, nor let the plan grow.
    cut = search.nearest(df, F.col("vec_id") % 100 == 0, query_block=7)
    assert "MapInArrow" not in cut._jdf.queryExecution().optimizedPlan().toString()
    again = {}
    for r in cut.collect():
        again.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(f) for q, f in again.items()} == got
    few = search.nearest(df.filter("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]
    assert search.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


# licences ---------------------------------------------------------------------------------------


def test_licenses(spark):
    mit = "Released under the MIT License."
    rows = [("a/LICENSE", mit), ("a/x.py", "print"), ("a/b/y.py", None), ("a/b/c/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("a/b/c/z.py", "code"), ("d/w.py", "some\nThis work is licensed under the GNU General Public License, version 3.\nmore"), ("d/v.py", "the of and " * 3000), ("top.py", ""), (None, mit), ("a/x.py", "print")]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("licence", F.lit("?"))
    got = {r["path"]: (r["licence"], r["origin"], r["origin_dir"]) for r in licenses.scan(df).collect()}
    assert got["a/LICENSE"] == ("MIT", "own", None) and got["a/x.py"] == ("MIT", "inherited", "a") and got["a/b/y.py"] == ("MIT", "inherited", "a")
    assert got["a/b/c/z.py"] == ("Apache-2.0", "inherited", "a/b/c") and got["d/w.py"] == ("GPL-3.0", "own", None)
    assert got["d/v.py"] == (None, "none", None) and got["top.py"] == (None, "none", None)
    assert licenses.scan(df.limit(0)).count() == 0


def test_ties_go_to_the_smaller_name(spark):
    df = spark.createDataFrame([("x.py", "free to all who ask")], "path string, text string")
    for names in (("AAA", "ZZZ"), ("ZZZ", "AAA")):
        assert licenses.own_licences(df, templates={n: ["Free to all who ask."] for n in names}).first()["licence"] == "AAA"


def test_headers_and_one_hot_directory(spark):
    apache = "# Licensed under the Apache License, Version 2.0\n# (the License); you may not use this file except in\n# compliance with the License.\n\ncode"
    rows = [("hot/LICENSE", "SPDX-License-Identifier: ISC"), ("h.py", apache), *((f"hot/{i}.py", "x") for i in range(900))]
    got = {r["path"]: (r["licence"], r["origin"]) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["h.py"] == ("Apache-2.0", "own") and got["hot/LICENSE"] == ("ISC", "own") and {got[f"hot/{i}.py"] for i in range(900)} == {("ISC", "inherited")}


def test_documents_as_files(spark, tmp_path):
    rows = [(50, "Released under the MIT License.", "en", "s"), (51, "x", "en", "s"), (-3, None, "en", "s"), (None, "x", None, "s"), (7, "x", "de", None), (10, "Licensed under CC BY-NC 4.0.", "en", "s"), (30, "", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["licence"], r["origin"], r["origin_dir"]) for r in licenses.op3_licenses(spark, str(tmp_path)).collect()}
    assert got == {50: ("MIT", "own", None), 51: ("MIT", "inherited", "s/en"), -3: ("MIT", "inherited", "s/en"), None: (None, "none", None), 7: (None, "none", None), 10: ("CC-BY-NC-4.0", "own", None), 30: ("CC-BY-NC-4.0", "inherited", "s/en/shelf10")}


def test_every_template_is_found(spark):
    rows = [(f"{name}.{k}", f"intro\n{t}\nend") for name, ts in licenses.TEMPLATES.items() for k, t in enumerate(ts)]
    got = {r["path"]: r["licence"] for r in licenses.own_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: p.rsplit(".", 1)[0] for p, _ in rows} == got


def test_json_parts_stay_text():
    f = chat.Flattener()
    f.visit({"type": "text", "text": json.dumps([{"type": "image"}])})
    assert f.refs == [] and f.text() == '[{"type": "image"}]'
