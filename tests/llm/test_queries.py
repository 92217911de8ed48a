"""Each registered query itself, on a small folder with nulls, empty, very long, repeated rows and foreign columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lineloom.llm import entries
from lineloom.llm.packing import vocabulary_path

from . import brute
from .test_ops import auc, junk, prose

FOREIGN = "lang string, source string, n_chars long, size long, slot long, shard int, score double, found string, __h string, __place long, __task long, label int, term string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(41)
    path = tmp_path_factory.mktemp("tables")
    bench = [(i, prose(rng, 30)) for i in range(6)] + [(6, "short one"), (None, "no id"), (7, None)]
    texts = []
    for i in range(260):
        t = junk(rng) if i % 9 == 0 else prose(rng, rng.randint(20, 120))
        texts.append(t + (f" {rng.choice(['grobian', 'lump'])} schuft" if i % 6 == 1 else ""))
    texts[3] += f' token = "{"0123456789abcdef" * 2}" AKIA{"Q7" * 8} ' + "ghp_" + "".join(rng.choices("abcXYZ09", k=36))
    texts[4] = texts[4] + " " + bench[0][1] + " " + bench[1][1]
    texts += [texts[5]] * 40 + [None] * 3 + ["", " \n", "x" * 50_000, prose(rng, 50_000), "<|endoftext|> Ä ß", "-3"]
    ids = [*range(len(texts) - 2), -3, None]
    rows = [(i, t, "en", "s", 1, 2, 3, 4, 0.5, "f", "h", 5, 6, 7, "t") for i, t in zip(ids, texts)]
    rows += [rows[0], rows[-1], (9, "other text", *rows[0][2:])]
    spark.createDataFrame(rows, "doc_id long, text string, " + FOREIGN).repartition(4).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 9 > 0), int(i % 6 == 1)) for i in range(260)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    gen = np.random.default_rng(3)
    vectors = [(i, gen.standard_normal(8).tolist()) for i in range(800)] + [(900, None), (1000, [0.0] * 8), (None, [1.0] * 8), (1100, [float("nan")] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(str(path / "embeddings.parquet"))
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 0, "assistant", "x" * 50_000), (3, 0, "assistant", "c"), (3, 0, "assistant", "c")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(path / "conversations.parquet"))
    return str(path), [(r[0], r[1]) for r in rows], bench, turns


def run(spark, folder, name):
    return [r.asDict() for r in entries.QUERIES[name](spark, folder[0]).collect()]


def held(i, mod, rest):
    return i is not None and zlib.crc32(str(i).encode()) % mod == rest


@pytest.mark.parametrize("name, mod, rest, label", [("op1_quality", 5, 0, lambda i: i % 9 > 0), ("op7_toxicity", 4, 2, lambda i: i % 6 == 1)])
def test_classifiers(spark, folder, name, mod, rest, label):
    rows = run(spark, folder, name)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(i) for i, _ in folder[1])
    assert all(r["held_out"] == held(r["doc_id"], mod, rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    out = [(r["score"], label(r["doc_id"])) for r in rows if r["held_out"] and 0 <= r["doc_id"] < 260]
    assert auc(out) > 0.95


def rendezvous(i, n):
    def u(shard):
        seed = xxhash.xxh64_intdigest(b"shard", 42)
        seed = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), seed)
        bits = seed if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed)
        return ((bits >> 11) + 0.5) / 2.0**53

    return max(range(n), key=lambda s: (-1.0 / np.log(u(s)), -s))


def test_sharding(spark, folder):
    rows = run(spark, folder, "op2_sharding")
    assert len(rows) == len(folder[1])
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in folder[1])
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    assert all(r["law"] == "key" and r["shard"] == rendezvous(r["doc_id"], 8) and r["grown_shard"] == rendezvous(r["doc_id"], 9) for r in rows)
    for s in range(8):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))


def test_licences(spark, folder):
    assert {r["doc_id"] for r in run(spark, folder, "op3_licenses")} == {i for i, _ in folder[1]}


def test_decontaminate(spark, folder):
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in run(spark, folder, "op4_decontaminate"))
    items = [(i, t) for i, t in folder[2] if i is not None]
    assert got == sorted((str(i), *h) for (i, _), h in zip(folder[1], brute.hits([t for _, t in folder[1]], items)))
    assert any(g[5] for g in got)


def test_packing(spark, folder):
    t = Tokenizer.from_file(vocabulary_path())
    ids = {(i, x): t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in folder[1]}
    want = sorted((str(i), s, zlib.crc32(np.array(ids[i, x][s : s + 2048], "<u4").tobytes()), len(ids[i, x])) for i, x in folder[1] for s in range(0, len(ids[i, x]), 2048))
    rows = run(spark, folder, "op5_packing")
    assert sorted((str(r["doc_id"]), r["start"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for w in used.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:k]) for k in range(len(w))] and sum(n for _, n in w) <= 2048


def test_search(spark, folder):
    rows = run(spark, folder, "op6_search")
    assert {r["query_id"] for r in rows} == set(range(0, 800, 100)) and len(rows) == 80
    assert all(r["query_id"] != r["vec_id"] for r in rows) and {r["rank"] for r in rows} == set(range(1, 11))


def test_simhash(spark, folder):
    rows = run(spark, folder, "op8_simhash")
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in rows) == sorted((str(i), f"{brute.fingerprint(t):016x}") for i, t in folder[1])
    fps = {f: int(f, 16) for f in {r["fingerprint"] for r in rows}}
    ids = {}
    for r in rows:
        ids.setdefault(r["fingerprint"], []).append(r["doc_id"])
    least = {f: min(i for g in group for i in ids[g] if i is not None) for group in brute.components(fps) for f in group if any(i is not None for g in group for i in ids[g])}
    assert all(r["component_id"] == least.get(r["fingerprint"]) for r in rows)


def test_secrets(spark, folder):
    rows = run(spark, folder, "op9_secrets")
    by = {}
    for i, t in folder[1]:
        by.setdefault(i, []).append(t)
    for r in rows:
        wanted = [brute.secrets(t) for t in by[r["doc_id"]]]
        assert r["base_sha256"] in {hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in w).encode()).hexdigest() for w in wanted}
    three = next(r for r in rows if r["doc_id"] == 3)
    at = by[3][0].index("ghp_")
    assert f"learned:{at}:{at + 40}" in three["spans"].split(",") and (three["n_assign"], three["n_access"], three["n_hex"]) == (1, 1, 1)
    assert sum("learned" in r["spans"] for r in rows) == 1


def test_chat(spark, folder):
    rows = {r["conv_id"]: r for r in run(spark, folder, "op10_chat")}
    turns = [*folder[3], (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(rows) == {t[0] for t in turns}
    for c, r in rows.items():
        mine = [t for t in turns if t[0] == c]
        text = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and r["formatted_chars"] > len(loss)
