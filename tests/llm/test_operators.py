"""Each operator against brute force, round trips or held-out labels, and on nulls, empty texts, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, node long, row long, line string"


def docs(spark, texts, start=0):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(start + k, t, "en", "s", len(t or ""), 1, 2, 3, "x") for k, t in enumerate(texts)], SCHEMA)


def words(rnd, n):
    return [rnd.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]) + str(rnd.randrange(9)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(1)
    return [None, "", " ", "a b", "a b", "\n\n", "ñandú €😀 \x1c x", "x" * 30_000, " ".join(words(rnd, 9000)), " ".join(words(random.Random(1), 9000)), "0123456789" * 400, "@@@...+++AKIA token=" * 50]


def test_join_equals_brute_force(spark, odd):
    from pricelore.llm import near_duplicates as m

    rnd, texts = random.Random(4), list(odd)
    for _ in range(12):
        base = words(rnd, rnd.randint(30, 90))
        for _ in range(rnd.randint(1, 12)):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = "changed" + str(rnd.randrange(99))
            texts.append(" ".join(own))
    sets = m.shingles(texts)
    links, parent = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    plain = [tuple(re.findall(r"[^\W_]+", (t or "").lower())) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            shared = len(np.intersect1d(sets[a], sets[b]))
            alike = shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared) - 1e-9 if len(sets[a]) and len(sets[b]) else not len(sets[a]) and not len(sets[b]) and plain[a] == plain[b]
            if alike:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in m.join(docs(spark, texts)).collect()}
    assert got == {k: (find(k), links[k]) for k in range(len(texts))}
    kept = {r["doc_id"] for r in m.one_of_each(docs(spark, texts)).collect()}
    assert kept == {find(k) for k in range(len(texts))}


def test_join_in_blocks(spark, monkeypatch):
    from pricelore.llm import near_duplicates as m

    monkeypatch.setattr(m, "BLOCK", 4)
    rnd = random.Random(6)
    base = words(rnd, 200)
    texts = [" ".join(base[:k] + ["other"] + base[k + 1 :]) for k in range(30)]
    got = m.join(docs(spark, texts)).collect()
    assert {r["class_id"] for r in got} == {0} and {r["n_links"] for r in got} == {29}


def test_forest_equals_runs_of_sorted_signatures(spark):
    """Ties over many small partitions, whose edges cut runs, against runs found in one sorted list."""
    from pricelore.llm import near_duplicates as m

    rnd = random.Random(8)
    stems = [bytes(rnd.randrange(256) for _ in range(8)) for _ in range(6)]
    rows = []
    for k in range(400):
        trees = []
        for _ in range(3):
            keep = rnd.randint(4, 8)
            trees.append(int.from_bytes(rnd.choice(stems)[:keep] + bytes(rnd.randrange(3) for _ in range(8 - keep)), "big", signed=True))
        rows.append((k.to_bytes(16, "big"), trees))
    classes = spark.createDataFrame(rows, "key binary, signature array<bigint>")
    want = {}
    for depth in m.depths(6):
        for tree in range(3):
            runs = {}
            for node, trees in rows:
                runs.setdefault((trees[tree] % 2**64) >> (64 - 8 * depth), []).append(node)
            for nodes in runs.values():
                for n in nodes:
                    if n != min(nodes):
                        key = depth, n, min(nodes)
                        want[key] = want.get(key, 0) + 1
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {(r["depth"], bytes(r["node"]), bytes(r["head"])): r["trees"] for r in m.forest(classes, 6).collect()}
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert got == want


def test_prefixes_are_shortened_for_open_classes_only(spark):
    """A family of near copies is done at the full depth; a pair near the threshold is met by shorter prefixes."""
    from pricelore.llm import near_duplicates as m

    rnd = random.Random(14)
    base = [f"w{k}" for k in range(300)]
    family = [" ".join(base[:k] + [f"other{k}"] + base[k + 1 :]) for k in range(3, 297, 6)]
    pairs = []
    for p in range(12):
        one = [f"p{p}x{k}" for k in range(120)]
        two = list(one)
        for k in range(6, 114, 18 + p % 3):
            two[k] = f"q{p}x{k}"
        pairs += [" ".join(one), " ".join(two)]
    lonely = [" ".join(words(rnd, 50)) for _ in range(20)]
    frame = docs(spark, family + pairs + lonely)
    threshold, recall = 0.55, 0.9
    least = m.last_depth(threshold, recall)
    assert least < m.DEPTH - 2
    sets = m.shingles(family + pairs + lonely)
    known = m.cut(m.keyed(frame))
    classes = m.cut(known.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("signature").alias("signature")))
    found = m.cut(m.links(frame, classes, threshold, recall))
    ids = {bytes(r["key"]): r["doc_id"] for r in known.collect()}
    turns = {}
    for r in found.collect():
        turns.setdefault(ids[bytes(r["node"])], {}).setdefault(r["depth"], 0)
        turns[ids[bytes(r["node"])]][r["depth"]] += r["links"]
    n = len(family)
    exact = [sum(m_ >= threshold for m_ in (len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for b in range(len(sets)) if b != a)) for a in range(n + len(pairs))]
    assert [sum(turns.get(a, {}).values()) for a in range(n + len(pairs))] == exact and sum(exact[n:]) == len(pairs)
    assert all(set(turns[a]) == {m.DEPTH} for a in range(n))  # the family: nothing left for shorter prefixes
    assert min(d for a in range(n, n + len(pairs)) for d in turns[a]) < m.DEPTH  # pairs: the prefix really fell
    done = {ids[bytes(r["node"])] for r in m.closed(found.where(F.col("depth") == m.DEPTH), m.DEPTH, least, threshold, recall).collect()}
    assert done >= set(range(n)) and not done & set(range(n, n + len(pairs)))


def test_empty_tables(spark):
    from pricelore.llm import decontaminate, flac, licence_scan, near_duplicates, personal_data, piece_sampling, secret_scan, toxicity, url_filter

    none = docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_duplicates.join(none).count() == 0
    assert decontaminate.find(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert secret_scan.scan(none).count() == 0
    assert personal_data.redact(none).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert flac.decode(flac.encode(none)).count() == 0
    assert piece_sampling.sample(none, piece_path()).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert licence_scan.scan(none, *licence_scan.fit(none)).count() == 0


def test_containment_equals_brute_force(spark, odd):
    from pricelore.llm import decontaminate as m

    rnd = random.Random(9)
    items = [words(rnd, n) for n in (3, 5, 7, 12, 40, 150, 400)]
    texts = list(odd)
    for item in items:
        for drop in (0, 1, len(item) // 6, len(item) // 2):
            texts.append(" ".join(words(rnd, 300) + item[drop:] + words(rnd, 300)).upper())
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(97, None), (98, ""), (None, "a b c d e f")], "item_id long, text string")

    def runs(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    expected = set()
    for d, t in enumerate(texts):
        have = runs(t)
        for k, i in enumerate(items):
            want = runs(" ".join(i))
            if want and len(have & want) >= 0.8 * len(want):
                expected.add((d, k, len(have & want), len(want)))
    found = m.find(docs(spark, texts), bench)
    assert {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in found.collect()} == expected and len(expected) >= 12
    kept = {r["doc_id"] for r in m.clean(docs(spark, texts), bench).collect()}
    assert kept == set(range(len(texts))) - {e[0] for e in expected}


def test_secrets_base_equals_patterns(spark, odd):
    from pricelore.llm import secret_scan as m

    rnd = random.Random(2)
    texts = list(odd) + ["".join(rnd.choice(["token", "=", ": ", "secret", "api_key", "AKIA", "ABCD2345", "deadbeef", "é", " ", '"', "'", "x", "PassWord", "\n"]) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    got = {r["doc_id"]: r for r in m.scan(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        t, spans = t or "", []
        for x in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
            spans += [(x.start(), 0, x.end())] if len(x[2]) >= 8 else []
        spans += [(x.start(), 1, x.end()) for x in re.finditer("AKIA[A-Z0-9]+", t) if len(x[0]) >= 16]
        spans += [(x.start(), 2, x.end()) for x in re.finditer("[0-9a-f]+", t) if len(x[0]) >= 32]
        assert [(s["start"], s["rank"], s["end_"]) for s in got[k]["base"]] == sorted(spans), t
        assert all(s in got[k]["spans"] for s in got[k]["base"])


def test_secrets_of_texts_with_very_many(spark):
    """Places over several chunks, and overlaps with base spans at chunk edges."""
    from pricelore.llm import secret_scan as m

    rnd, letters = random.Random(3), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    parts = [rnd.choice([f"token={drawn(24)}", drawn(24), "é plain", "AKIA" + "ABCDEFGHIJKLMNOPQRST", "deadbeef" * 4]) for _ in range(m.CHUNK * 3 + 7)]
    text = " ".join(parts)
    weights = m.fit(docs(spark, [" ".join(words(rnd, 200)) for _ in range(30)]))
    got = m.scan(docs(spark, [text]), weights).first()
    base = [(x.start(), 0, x.end()) for x in re.finditer(r"token=[A-Za-z0-9+/_.=-]+", text)] + [(x.start(), 1, x.end()) for x in re.finditer("AKIA[A-Z0-9]{12,}", text)] + [(x.start(), 2, x.end()) for x in re.finditer("[0-9a-f]{32,}", text)]
    assert [(s["start"], s["rank"], s["end_"]) for s in got["base"]] == sorted(base)
    added = [(s["start"], s["end_"]) for s in got["spans"] if s["rank"] == 3]
    alone = [(x.start(), x.end()) for x in re.finditer(r"(?<!\S)[A-Za-z0-9]{24}(?!\S)", text) if not x[0].startswith("AKIA")]
    assert set(added) <= set(alone) and len(added) >= 0.9 * len(alone) and not any(a < z2 and a2 < z for a, z in added for a2, _, z2 in base)


def test_random_strings_stand_out(spark):
    from pricelore.llm import secret_scan as m

    rnd = random.Random(12)
    weights = m.fit(docs(spark, [" ".join(words(rnd, 200)) for _ in range(30)]))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = ["".join(rnd.choice(letters) for _ in range(24)) for _ in range(200)]
    plain = ["internationalization_settings", "getUserAccountByIdentifier", "MAX_CONNECTION_POOL_SIZE", "com/articles/2024/11/28/breaking-news", "=" * 40, "2024-11-28-10-20-30-40"]
    got = {r["doc_id"]: [s["value"] for s in r["spans"]] for r in m.scan(docs(spark, [f"the key {d} here" for d in drawn] + plain), weights).collect()}
    assert sum(got[k] == [d] for k, d in enumerate(drawn)) >= 190
    assert not any(got[len(drawn) + k] for k in range(len(plain)))


def test_personal_data_equals_patterns():
    from pricelore.llm import personal_data as m

    rnd, anchors = random.Random(1), m.automaton()
    for k in range(4000):
        t = "".join(rnd.choice("ab@@..1234+ -()5%") for _ in range(rnd.randint(0, 60))) + ("".join(rnd.choice("4111111111111111 -") for _ in range(24)) if k % 3 == 0 else "")
        want = [("email", *x.span()) for x in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *x.span()) for x in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in x[0].split("."))]
        want += [("card", *x.span()) for x in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", x[0])) <= 19 and m.luhn(d)]
        want += [("phone", *x.span()) for x in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", x[0])) <= 15]
        assert [s for s in m.find(t, anchors) if s[0] in m.KINDS[:4]] == want, t
    kinds = lambda t: [s[0] for s in m.find(t, anchors)]
    assert "iban" in kinds("IBAN: GB82 WEST 1234 5698 7654 32.") and "iban" not in kinds("IBAN: GB82 WEST 1234 5698 7654 33.")
    assert kinds("see http://me:pw@example.com/x") == ["email", "login"] or "login" in kinds("see http://me:pw@host/x")
    assert kinds("at 12 Long Street, in town") == ["address"] and kinds("nothing here") == []


def test_redaction(spark, odd):
    from pricelore.llm import personal_data as m

    frame = docs(spark, [*odd, "mail bob@example.com or +49 170 1234567 now"])
    got = {r["doc_id"]: r for r in m.redact(frame).collect()}
    last = got[len(odd)]
    assert last["text"] == "mail <EMAIL> or <PHONE> now" and last["n_chars"] == len(last["text"])
    assert got[0]["text"] is None and got[1]["text"] == "" and m.redact(frame).columns == frame.columns


def test_toxicity_on_held_out_labels(spark, odd):
    from pricelore.llm import toxicity as m

    rnd, texts, labels = random.Random(5), [], []
    for k in range(600):
        bad = k % 5 == 0
        texts.append(" ".join([*words(rnd, 60), *(["vile", "nasty"] if bad else [])]))
        labels.append((k, 1, int(bad)))
    frame = docs(spark, texts).unionByName(docs(spark, odd, 10_000))
    model = m.fit(frame, spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in m.score(frame, model).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all((got[k] >= m.CUT) == (k % 5 == 0) for k in held) and len(held) > 100
    assert all(0 <= s <= 1 for s in got.values()) and got[10_000] == got[10_001]
    kept = m.harmless(frame, model)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {k for k, s in got.items() if s < m.CUT}
    nothing = m.fit(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] < 1e-9 for r in m.score(frame, nothing).collect()} == {True}


def test_risk_is_as_low_as_plain_descent_gets():
    """The non-negative risk by loops over texts, and its minimum by coordinate steps."""
    from pricelore.llm import toxicity as m

    rnd, n_words, prior = random.Random(31), 4, 0.3
    draw = lambda bad: np.array(sorted({w for w in range(n_words) if rnd.random() < ((0.7, 0.5, 0.2, 0.5) if bad else (0.1, 0.5, 0.6, 0.4))[w]}), dtype=np.int64)
    rows_p, rows_u = [draw(True) for _ in range(60)], [draw(rnd.random() < prior) for _ in range(300)]

    def risk(w, b):
        loss = lambda z: np.log1p(np.exp(-z))
        mean = lambda rows, sign: sum(loss(sign * (b + sum(w[k] for k in r))) for r in rows) / len(rows)
        return prior * mean(rows_p, 1) + max(0.0, mean(rows_u, -1) - prior * mean(rows_p, -1))

    w, b = m.nnpu(rows_p, rows_u, n_words, prior, epochs=1500, rate=0.02, l1=0.0)
    best, at, step = risk(np.zeros(n_words), 0.0), np.zeros(n_words + 1), 1.0
    while step > 1e-3:
        moved = False
        for k in range(n_words + 1):
            for d in (step, -step):
                to = at.copy()
                to[k] += d
                if (r := risk(to[:-1], to[-1])) < best - 1e-9:
                    best, at, moved = r, to, True
        step = step if moved else step / 2
    assert risk(w, b) <= best + 0.01 and w[0] > 0 > w[2]


def test_words_are_the_same_in_fit_and_score(spark):
    import regex

    from pricelore.llm import toxicity as m

    texts = ["cafe\u0301 na\u00efve", "\u0e01\u0e33 \u0915\u093f", "a_b-c d'e 1\u00bd \u2160", "\U0001f600 x\u200dy"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r["k"]: r["w"] for r in frame.select("k", F.regexp_extract_all(F.lower("t"), F.lit(m.WORD), F.lit(0)).alias("w")).collect()}
    assert all(got[k] == regex.findall(m.WORD, t.lower()) for k, t in enumerate(texts))


def piece_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_pieces_are_distinct_and_decode(spark, odd):
    import sentencepiece

    from pricelore.llm import piece_sampling as m

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    texts = [*odd, "Hello  world \n\nabc ñ 😀 x", "  lead", "trail  "]
    for r in m.sample(docs(spark, texts), piece_path(), 3).collect():
        text = texts[r["doc_id"]] or ""
        ids = [tuple(s["ids"]) for s in r["samples"]]
        assert len(set(ids)) == len(ids) >= 1 and all(s["text_ok"] for s in r["samples"])
        assert all(sp.decode(list(i)) == text for i in ids)


def test_pieces_follow_the_exact_law():
    from pricelore.llm import piece_sampling as m

    lattice = m.Lattice(piece_path())
    lat = lattice.build(["then"])

    def paths(slot):
        if lat["end"][slot]:
            return [((), 0.0)]
        a = lat["begin"][slot]
        return [((int(lat["id"][j]), *rest), lat["logp"][j] + p) for j in range(a, a + lat["degree"][slot]) for rest, p in paths(lat["next"][j])]

    law = {p: np.exp(w) for p, w in paths(int(lat["first"][0]))}
    assert abs(sum(law.values()) - 1) < 1e-9
    n = 6000
    first, second = {}, {}
    for got in m.top_k(lattice, ["then"] * n, np.arange(n, dtype=np.int64) * 7919 + 13, 2):
        a, b = (tuple(int(x) for x in ids) for ids, _ in got)
        first[a] = first.get(a, 0) + 1
        second[a, b] = second.get((a, b), 0) + 1
    for p, w in law.items():
        assert abs(first.get(p, 0) / n - w) < 4 * np.sqrt(w / n) + 2e-3
    top = max(law, key=law.get)
    for b, w in law.items():
        if b != top:
            want = law[top] * w / (1 - law[top])
            assert abs(second.get((top, b), 0) / n - want) < 4 * np.sqrt(want / n) + 2e-3


def test_token_store(spark, odd):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from pricelore.llm import token_store as m
    from pricelore.llm._common import shared_dir

    for hi in (2, 100, 50257, 2**31, 2**62):
        for n in (1, 5, 300):
            ids = np.random.default_rng(n).integers(0, hi, n).astype(np.uint64)
            w, e = m.pack_block(ids)
            assert (m.unpack(w, e, np.array([0]), n, n) == ids).all()
    path = f"{shared_dir(spark)}/tokens-test"
    texts = [*odd, "  a  b\n c ", "it's 'tis 123 45,6 ", "trail "]
    m.write_tokens(docs(spark, texts), path, P.path("byte_bpe_50k.json"))
    tokenizer, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in m.read_tokens(spark, path).collect()}
    for k, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_store_of_null_and_repeated_ids(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from pricelore.llm import token_store as m
    from pricelore.llm._common import shared_dir

    path, rows = f"{shared_dir(spark)}/tokens-odd", [(None, "b"), (None, None), (3, "x y"), (3, "x y"), (3, "a\u00a0b c\u2028d e\nf g"), (-1, "z<|endoftext|>")]
    m.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, P.path("byte_bpe_50k.json"))
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, m.read_tokens(spark, path).collect()), key=lambda r: r[1]) == want
    m.write_tokens(spark.createDataFrame([], "doc_id long, text string"), f"{path}-none", P.path("byte_bpe_50k.json"))
    assert m.read_tokens(spark, f"{path}-none").count() == 0


@pytest.mark.parametrize("block", [1, 7, 60, 64, 1000])
def test_blocks_are_decoded_alone(block):
    from pricelore.llm import token_store as m

    for n in (1, 59, 60, 61, 64, 257, 1000):
        for hi in (2, 300, 50257, 2**62):
            ids = np.random.default_rng(n).integers(0, hi, n).astype(np.uint64)
            words, escapes, offsets = m.pack(ids, block)
            assert (m.unpack(words, escapes, offsets, n, block) == ids).all() and len(offsets) == -(-n // block)
            for k, (a, z) in enumerate(zip(offsets, [*offsets[1:], len(words)])):
                if hi <= 2**60:
                    own = ids[k * block : (k + 1) * block]
                    assert (m.unpack(words[a:z], escapes[:0], np.array([0]), len(own), block) == own).all()


def test_flac_round_trip(spark, odd):
    from pricelore.llm import flac as m

    got = {r["doc_id"]: r for r in m.decode(m.encode(docs(spark, odd))).collect()}
    for k, t in enumerate(odd):
        raw = (t or "").encode()
        raw += b" " * ((-len(raw)) % 192 if raw else 192)
        assert got[k]["pcm"] == raw and got[k]["n_bytes"] == len((t or "").encode())
        samples, info, offsets = m.decode_stream(got[k]["media"]) if len(raw) < 5000 else ([[]], m.stream_info(got[k]["media"]), [])
        assert not samples[0] or bytes(s + 128 for s in samples[0]) == raw
        assert info["seek"][0][1] == 0 and info["md5"] == hashlib.md5(bytes((b - 128) % 256 for b in raw)).digest()
        assert [b["sample_offset"] for b in got[k]["blocks"]] == list(range(0, len(raw), m.SEEK * m.N))


def test_flac_blocks_and_faults(spark, odd, tmp_path):
    from pricelore.llm import flac as m

    media = m.encode(docs(spark, odd))
    m.write_blocks(m.decode(media), f"{tmp_path}/pcm")
    rows = spark.read.parquet(f"{tmp_path}/pcm").collect()
    for k, t in enumerate(odd):
        own = sorted((r["sample_offset"], r["block"], bytes(r["pcm"])) for r in rows if r["doc_id"] == k)
        raw = (t or "").encode()
        assert b"".join(p for *_, p in own) == raw + b" " * ((-len(raw)) % 192 if raw else 192)
        assert [o for o, *_ in own] == [b * m.SEEK * m.N for _, b, _ in own]
    broken = spark.createDataFrame([(1, 5, b"nothing"), (2, 5, None)], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: (r["pcm"], r["fault"] is not None) for r in m.decode(broken, strict=False).collect()}
    assert got == {1: (None, True), 2: (None, False)}


def test_flac_frame_numbers():
    from pricelore.llm import flac as m

    numbers = [0, 0x7F, 0x80, 0x7FF, 0x800, 0xFFFF, 0x10000, 0x10FFFF]
    got, size = m._number(np.array(numbers))
    for n, row, k in zip(numbers, got, size):
        assert 0xD800 <= n < 0xE000 or bytes(row[:k]) == chr(n).encode()
    got, size = m._number(np.array([0x1FFFFF, 0x200000, 0x3FFFFFF, 0x4000000, 0x7FFFFFFF, 0x80000000]))
    assert size.tolist() == [4, 5, 5, 6, 6, 7] and [row[0] for row in got] == [0xF7, 0xF8, 0xFB, 0xFC, 0xFD, 0xFE]


def test_flac_of_other_encoders():
    from pricelore.llm import flac as m

    bits = ""

    def put(value, n):
        nonlocal bits
        bits += format(value & (1 << n) - 1, f"0{n}b") if n else ""

    samples = [10, 12, 15, 19, 24, 30, 37, 45]
    put(0x7FFC, 15), put(0, 1), put(6, 4), put(0, 4), put(0, 4), put(0, 4), put(0, 8), put(len(samples) - 1, 8)
    head = int(bits, 2).to_bytes(len(bits) // 8, "big")
    put(int(m.crc(np.frombuffer(head, np.uint8)[None], False)[0]), 8)
    put((32 | 1) << 1, 8)  # quantised linear predictor of order 2
    put(samples[0], 16), put(samples[1], 16), put(4 - 1, 4), put(0, 5), put(2, 4), put(-1, 4)
    put(0, 2), put(1, 4)  # two Rice partitions
    residual = [samples[k] - 2 * samples[k - 1] + samples[k - 2] for k in range(2, len(samples))]
    for part in (residual[:2], residual[2:]):
        put(1, 4)
        for r in part:
            u = 2 * r if r >= 0 else -2 * r - 1
            bits += "0" * (u >> 1) + "1"
            put(u & 1, 1)
    bits += "0" * (-len(bits) % 8)
    frame = int(bits, 2).to_bytes(len(bits) // 8, "big")
    frame += int(m.crc(np.frombuffer(frame, np.uint8)[None], True)[0]).to_bytes(2, "big")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 15 << 36 | len(samples)).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80\x00\x00\x22" + info + frame
    assert m.decode_stream(stream)[0] == [samples]
    broken = bytearray(stream)
    broken[-4] ^= 1
    with pytest.raises(ValueError):
        m.decode_stream(bytes(broken))


def test_urls(spark):
    from pricelore.llm import url_filter as m

    urls = [None, "", "no scheme", "http://A.Example.com/en/7x", "http://b.com/en/1?q=1", "https://x.net/de/1", "https://c.example.net/de/8#a", "ftp://org/es/", "http://notcom/en/", "http://x.org?a://b", "http://com/en/"]
    got = {r["page_id"]: r for r in m.judge(spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string").withColumnRenamed("host", "html")).collect()}
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) for k in range(len(urls))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("b.com", "/en/1", "com/en/", "block"), ("x.net", "/de/1", "net/de/", "allow"),
        ("c.example.net", "/de/8", "example.net/de/8", "block"), ("org", "/es/", "org/es/", "block"), ("notcom", "/en/", None, "allow"), ("x.org", "", None, "allow"), ("com", "/en/", "com/en/", "block"),
    ]


def test_mined_rules_reach_unlabelled_pages(spark):
    from pricelore.llm import url_filter as m

    urls = [f"http://bad.example.org/es/{k}?ref=x" for k in range(60)] + [f"http://bad.example.org/xx/{k}?ref=x" for k in range(3)] + [f"http://good.example.net/en/{k}" for k in range(80)]
    got = m.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    judged = {r["page_id"]: (r["verdict"], r["rule"]) for r in got}
    assert all(judged[k] == ("block", "org/es/") for k in range(60))
    assert all(judged[k] == ("block", None) for k in range(60, 63)) and all(judged[k] == ("allow", None) for k in range(63, 143))


def test_mined_rules_of_four_tokens(spark):
    """Only the four tokens together lead to block; each three of them are as often on allowed pages."""
    from pricelore.llm import url_filter as m

    four = ["a", "b", "c", "d"]
    rows = [(four, "block")] * 30 + [([t for t in four if t != left], "allow") for left in four for _ in range(30)]
    ready = spark.createDataFrame([(k, t, (v, "r")) for k, (t, v) in enumerate(rows)], "page_id long, tokens array<string>, fixed struct<verdict: string, rule: string>")
    assert [r["antecedent"] for r in m.mine(ready).collect()] == [four]


def test_mined_rules_equal_brute_force(spark):
    """All token sets of small transactions, counted one by one."""
    from itertools import combinations

    from pricelore.llm import url_filter as m

    rnd = random.Random(21)
    rows = []
    for k in range(400):
        t = sorted({rnd.choice("abcdefg") for _ in range(rnd.randint(0, 5))})
        bad = ("a" in t and "b" in t) or "c" in t and "d" not in t and rnd.random() < 0.95
        rows.append((k, t, rnd.random() < 0.6 and ("block" if bad else "allow") or None))
    labelled = [(t, v) for _, t, v in rows if v]
    n, blocked = len(labelled), sum(v == "block" for _, v in labelled)
    rules = {}
    for size in range(1, 8):
        for a in combinations("abcdefg", size):
            held = [v for t, v in labelled if set(a) <= set(t)]
            hits = held.count("block")
            if not hits or hits / n < max(m.SUPPORT, m.LEAST_PAGES / n) or hits / len(held) < m.CONFIDENCE:
                continue
            c, p = hits / len(held), len(held)
            low = (c + m.Z**2 / (2 * p) - m.Z * np.sqrt((c * (1 - c) + m.Z**2 / (4 * p)) / p)) / (1 + m.Z**2 / p)
            everywhere = sum(set(a) <= set(t) for _, t, _ in rows) / len(rows)
            if low > m.SURE and hits / blocked >= m.LIFT * everywhere:
                rules[a] = c
    want = {a: c for a, c in rules.items() if not any(set(g) < set(a) and d >= c for g, d in rules.items())}
    ready = spark.createDataFrame([(k, t, (v, "r") if v else None) for k, t, v in rows], "page_id long, tokens array<string>, fixed struct<verdict: string, rule: string>")
    got = {tuple(r["antecedent"]): r["confidence"] for r in m.mine(ready).collect()}
    assert got.keys() == want.keys() and len(want) >= 2 and all(abs(got[a] - want[a]) < 1e-9 for a in want)


@pytest.mark.parametrize(("n", "rules"), [(2, []), (3, [["bad"]])])
def test_mined_rules_are_significant(spark, n, rules):
    from pricelore.llm import url_filter as m

    rows = [(["bad"], "block")] * n + [(["good"], "allow")] * 50
    ready = spark.createDataFrame([(k, t, (v, "r")) for k, (t, v) in enumerate(rows)], "page_id long, tokens array<string>, fixed struct<verdict: string, rule: string>")
    assert [r["antecedent"] for r in m.mine(ready).collect()] == rules


def test_licences(spark, odd):
    from pricelore.llm import licence_scan as m

    rnd = random.Random(3)
    plain = [" ".join(words(rnd, 40)) for _ in range(60)]
    texts = [*odd, *plain, "one two\nReleased under the MIT License.\nthree", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Zebra House Licence."]
    frame = docs(spark, texts)
    got = {(r["doc_id"], r["line_no"]): r["family"] for r in m.scan(frame, *m.fit(frame)).collect()}
    n = len(odd) + len(plain)
    assert got == {(n, 1): "mit", (n + 1, 0): "cc", (n + 2, 0): "gpl", (n + 3, 0): "unknown"}


def test_licence_chances_on_families_never_seen(spark):
    """Calibration on held-out rows, scores against a plain scorer, and licences of held-out families: unknown, not another family."""
    from pricelore.llm import licence_scan as m

    rnd = random.Random(8)
    frame = docs(spark, [" ".join(words(rnd, 60)) for _ in range(120)])
    data = m.training_rows(frame)
    model, temperature = m.learn(data)
    assert m.calibration_error(data, model, temperature) < 0.1
    held = [f.format(n) for n in m.HELD_OUT_LICENCES for f in m.FRAMES]
    scanned = {r["doc_id"]: (r["family"], r["chance"]) for r in m.scan(docs(spark, held, 1000), model, temperature).collect()}
    assert len(scanned) >= 0.9 * len(held) and sum(f == m.UNKNOWN for f, _ in scanned.values()) >= 0.9 * len(scanned)
    # brute force: the same grams, hashed by Spark one text at a time, weighed in plain loops
    from pyspark.ml.feature import HashingTF

    weights, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    hashing = HashingTF(numFeatures=m.FEATURES)
    for k in range(0, len(held), 7):
        w = re.findall(r"[^\W_]+", held[k].lower())
        found = {hashing.indexOf(g) for g in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]}
        raw = np.array([bias[c] + sum(weights[c][i] for i in found) for c in range(len(m.CLASSES))]) / temperature
        p = np.exp(raw - raw.max()) / np.exp(raw - raw.max()).sum()
        if 1000 + k in scanned:
            family, chance = scanned[1000 + k]
            assert any(abs(chance - x) < 1e-6 for x in p) and p.argmax() > 0


def test_licence_texts_without_names(spark):
    """Wordings that are in no frame: wrapped and changed parts of licence texts."""
    from pricelore.llm import licence_scan as m

    rnd = random.Random(5)
    texts = [" ".join(words(rnd, 40)) for _ in range(60)] + [
        "Permission is hereby granted, free of charge, to anyone obtaining a copy of this software and its associated documentation files, to deal in the Software without restriction",
        "Redistribution and use in source and binary forms, with or without any modification, are permitted provided that these conditions are met",
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE",
        "you may not use these files except in compliance with the License. You may obtain a copy of the License at the address below",
        "The material may be shared: you must give appropriate credit, provide a link to the license, and indicate if changes were made.",
    ]
    frame = docs(spark, texts)
    got = {r["doc_id"]: r["family"] for r in m.scan(frame, *m.fit(frame)).collect()}
    assert got == {60: "mit", 61: "bsd", 62: "mit", 63: "apache", 64: "cc"}


def test_licences_inside_long_lines(spark):
    from pricelore.llm import licence_scan as m

    rnd = random.Random(6)
    texts = [" ".join(words(rnd, n)) for n in (40, 300, 900, 3000) for _ in range(20)]
    texts += [" ".join(x for w in words(rnd, 60) for x in (w, rnd.choice(["mit", "der", "und"]))) for _ in range(10)]  # no MIT licence
    n = len(texts)
    for inside, size, at in (("Released under the MIT License.", 400, 0), ("Licensed under the Apache License, Version 2.0.", 900, 450), ("This work is licensed under CC BY-SA 3.0.", 4000, 3990), ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", 2000, 1500)):
        w = words(rnd, size)
        texts.append(" ".join([*w[:at], inside, *w[at:]]))
    frame = docs(spark, texts)
    got = {r["doc_id"]: r["family"] for r in m.scan(frame, *m.fit(frame)).collect()}
    assert got == {n: "mit", n + 1: "apache", n + 2: "cc", n + 3: "bsd"}


@pytest.mark.parametrize("n", [0, 1, 24, 25, 63, 64, 65, 104, 105, 1000])
def test_windows_cover_the_line(spark, n):
    from pricelore.llm import licence_scan as m

    w = [f"w{k}" for k in range(n)]
    got = spark.createDataFrame([(" ".join(w),)], "line string").select(m.windows(F.col("line")).alias("x")).first()["x"]
    assert [x for x in dict.fromkeys(y for g in got for y in g)] == w
    assert all(any(w[k : k + m.OVERLAP] == g[i : i + m.OVERLAP] for g in got for i in range(len(g))) for k in range(max(n - m.OVERLAP + 1, 0)))


def test_pipeline_columns(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(7)
    texts = [" ".join(words(rnd, 50)) for _ in range(40)]
    texts += [texts[0], texts[1] + " end", "mail bob@example.com " + " ".join(words(rnd, 50)), None, ""]
    frame = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    item = " ".join(words(rnd, 30))
    frame = frame.unionByName(docs(spark, [texts[3] + " and " + item], 900).select(*frame.columns))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r["doc_id"]: r["samples"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = {40, 41, 44, 900}  # a copy, a near copy, the second of two texts without words, a leak
    assert kept.keys() == {*range(45)} - gone
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "PII", "SentencePiece"]


def test_counts(spark):
    from pricelore.llm import personal_data as m

    frame = docs(spark, ["a@b.co 1.2.3.4", None])
    got = m.scan(frame).select(F.size("spans").alias("n")).collect()
    assert [r["n"] for r in got] == [2, 0]


def test_queries_return_their_columns(spark, tmp_path, odd):
    """Each contracted query over a small table with every kind of text."""
    from pricelore.llm import registry

    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = [*odd, "token=ABCDEFGH12345678 me@x.org, 1.2.3.4, 4111 1111 1111 1111, +49 170 1234567 x", "abc"]
    frame = docs(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k == 1)) for k in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "http://a.com/en/x", ""), (2, None, "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = {n.split("_")[0]: {r[0]: r for r in q(spark, str(tmp_path)).collect()} for n, q in registry.QUERIES.items() if n.split("_")[0] in ("op4", "op5", "op6", "op8", "op9", "op10")}
    sha = lambda s: hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()
    k = len(odd)
    four, five, six, eight, nine, ten = (run[n] for n in ("op4", "op5", "op6", "op8", "op9", "op10"))
    assert all(len(x) == len(texts) for x in (four, five, six, eight, nine))
    assert (four[k]["n_assign"], four[k]["n_access"], four[k]["n_hex"], four[k]["base_sha256"], four[k]["spans"]) == (1, 0, 0, sha("assign:0:22"), "assign:0:22")
    want = [(kind, *re.search(p, texts[k]).span()) for kind, p in (("email", r"me@x\.org"), ("ip", r"1\.2\.3\.4"), ("card", "4111 1111 1111 1111"), ("phone", r"\+49 170 1234567"))]
    assert five[k]["base_sha256"] == sha(",".join(f"{a}:{b}:{c}" for a, b, c in want)) and five[0]["base_sha256"] == sha("")
    assert (five[k]["n_email"], five[k]["n_ip"], five[k]["n_card"], five[k]["n_phone"]) == (1, 1, 1, 1)
    assert all(six[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= six[d]["score"] <= 1 and six[d]["predicted"] == int(six[d]["score"] >= 0.3) for d in six)
    tokenizer, at = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0
    for d, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (eight[d]["start"], eight[d]["n_tokens"], eight[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        raw = (t or "").encode()
        raw += b" " * ((-len(raw)) % 192 if raw else 192)
        assert (nine[d]["n_bytes"], nine[d]["payload_bytes"], nine[d]["payload_sha256"], nine[d]["tail_crc32"]) == (len((t or "").encode()), len(raw), sha(raw), zlib.crc32(raw[-16:])) and nine[d]["media_bytes"] > 0 and len(nine[d]["media_sha256"]) == 64
    assert (ten[1]["host"], ten[1]["path"], ten[1]["rule"], ten[1]["verdict"], ten[2]["host"], ten[2]["rule"], ten[2]["verdict"]) == ("a.com", "/en/x", "com/en/", "block", "", None, "allow")


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_clashing_columns_and_null_ids(spark, tmp_path):
    import corpus_pipeline

    frame = docs(spark, ["a b c d e f g h", None, ""]).unionByName(docs(spark, ["other words of some length here"]).withColumn("doc_id", F.lit(None).cast("long")))
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == frame.columns, name
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in rows.collect()) == [-1, 0, 1]


def test_long_urls_are_mined_in_bounded_steps(spark):
    """Five copies of a url of 40 steps, and a chain of 40 nested paths with both labels, among 500 pages: few rules, in seconds."""
    from pricelore.llm import url_filter as m

    rnd = random.Random(41)
    long = "/".join(f"deep{k}" for k in range(40))
    chain = [f"http://{host}/{side}/" + "/".join(f"part{j}" for j in range(k + 1)) for k in range(40) for host, side in (("a.com", "en"), ("b.com", "en"), ("c.net", "de"), ("d.com", "en"))]
    urls = [f"http://s{rnd.randrange(9)}.com/en/{rnd.randrange(99)}" for _ in range(200)] + [f"http://s{rnd.randrange(9)}.net/de/{rnd.randrange(99)}" for _ in range(300)]
    urls += [f"http://com/en/{long}"] * 5 + [f"http://net/de/{long}x"] * 5 + chain
    ready = m.prepared(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).persist()
    began = time.time()
    rules = m.mine(ready).collect()
    assert time.time() - began < 60 and 1 <= len(rules) < 100
    judged = {r["page_id"]: r["verdict"] for r in m.judge(spark.createDataFrame([*enumerate(urls), (9_999, None)], "page_id long, url string")).collect()}
    assert len(judged) == len(urls) + 1 and judged[9_999] == "allow" and all(judged[k] == "block" for k in range(500, 505))
    ready.unpersist()


def test_sample_of_repeated_labelled_ids_is_bounded(spark):
    """1,000 rows of a labelled id, and labels that repeat it, are one document of the sample."""
    from pricelore.llm import toxicity as m

    texts = [" ".join(["word", "vile" if k % 3 == 0 else "kind", str(k)]) for k in range(120)]
    ids = [k for k in range(120) if zlib.crc32(str(k).encode()) % 4 != 2]
    hot = next(k for k in ids if k % 3 == 0)
    once = docs(spark, texts)
    often = once.unionByName(once.where(F.col("doc_id") == hot).crossJoin(spark.range(999).select()))
    labels = [(k, 1, int(k % 3 == 0)) for k in range(120)]
    schema = "doc_id long, quality int, toxic int"
    plain = m.fit(once, spark.createDataFrame(labels, schema))
    again = m.fit(often, spark.createDataFrame(labels + [(hot, 1, 1)] * 1000 + [(None, 1, 1)], schema))
    assert often.count() == 1119 and plain["words"].keys() == again["words"].keys() and abs(plain["words"]["vile"] - again["words"]["vile"]) < 1e-6


def test_streets_of_any_length_and_edges_of_personal_data(spark):
    from pricelore.llm import personal_data as m

    name = "Long" + "g" * 300
    frame = docs(spark, [f"at 12 {name} Old Road now", "123456 A Street", "no 7 Main Street", "7 Main Streets", None]).unionByName(docs(spark, ["at 12 Oak Avenue"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end_"]) for s in r["spans"] if s["kind"] == "address"] for r in m.scan(frame).collect()}
    assert got == {0: [("address", 3, 3 + len(f"12 {name} Old Road"))], 1: [], 2: [("address", 3, 16)], 3: [], 4: [], None: [("address", 3, 16)]}
    assert m.scan(docs(spark, [])).count() == 0


def test_long_tokens_are_learnt_from_with_bounded_weight(spark):
    """A run of 20,000 characters counts like one of TOKEN_WEIGHT pairs, and isn't dropped."""
    from pricelore.llm import secret_scan as m

    rnd = random.Random(3)
    plain = [" ".join(words(rnd, 40)) for _ in range(20)]
    at = lambda a, b: m.ALPHABET.index(a) * m.SIZE + m.SIZE + m.ALPHABET.index(b) + 1
    zq = lambda n: m.fit(docs(spark, [*plain, "zq" * n]))[at("z", "q")]
    none, short, long, longer = zq(0), zq(100), zq(10_000), zq(40_000)
    assert long < short < none and abs(long - longer) < 0.05


def test_chances_of_other_edges_are_sums():
    """Where one edge has nearly all the chance, what is left isn't lost in rounding."""
    from pricelore.llm import piece_sampling as m

    class Known:
        logp = np.log(np.array([1.0, 1e-18, 3e-20, 0.25, 0.75, 1.0]))
        upto = np.array([1.0, 1.0, np.inf, 0.25, np.inf, np.inf])

    got = m.others(Known, np.array([0, 0, 3, 5]), np.array([0, 1, 4, 5]))
    assert np.allclose(got, [1e-18 + 3e-20, 1.0, 0.25, 0.0], rtol=1e-9, atol=0)


def test_repeated_urls_are_kept_once(spark, monkeypatch):
    from pricelore.llm import url_filter

    rows = [f"http://a{n % 3}.com/en/x{n % 2}/y{n % 5}" for n in range(600)] + [f"http://b.net/de/x{n % 2}/y{n % 5}" for n in range(600)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    sizes, cut = [], url_filter.cut

    def counting(df):
        made = cut(df)
        sizes.append(made.count())
        return made

    monkeypatch.setattr(url_filter, "cut", counting)
    url_filter.mine(url_filter.prepared(pages)).collect()
    assert max(sizes) < 600


def test_few_rules_are_one_partition_and_many_are_the_same(spark, monkeypatch):
    from pricelore.llm import url_filter

    rows = [f"http://a{n % 3}.com/en/x{n % 2}/y{n % 5}" for n in range(600)] + [f"http://b.net/de/x{n % 2}/y{n % 5}" for n in range(600)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        few = url_filter.mine(url_filter.prepared(pages))
        assert few.rdd.getNumPartitions() == 1
        monkeypatch.setattr(url_filter, "TASK_ROWS", 1)
        many = url_filter.mine(url_filter.prepared(pages))
        assert few.count() and sorted(few.collect()) == sorted(many.collect())
    finally:
        spark.conf.unset(key)
