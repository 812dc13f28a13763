import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipeweave.llm import ann, common, hostrules, langid, mixing, neardup, packing, sstable, substring, tokens, toxicity, urlrules
from pipeweave.llm.tokens import default_tokenizer, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 8))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def table(spark, texts, ids=None):
    rows = [(i, t, "en", f"s{k % 2}" if k else None, None) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \n ", "one", "a b c d e f", "a b c d e f", "ß Ünï 中文 <|endoftext|> \x1c", "x " * 30_000]


@pytest.mark.parametrize("apply", [
    substring.passages, substring.without_passages, neardup.components, neardup.deduplicated, hostrules.judge, packing.pack, mixing.mix, mixing.mixed,
    sstable.write_and_read, langid.accepted, lambda d: langid.predict(d, langid.fit_documents(d)),
    lambda d: toxicity.score(d, toxicity.fit(d, d.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))),
], ids=lambda f: getattr(f, "__name__", "f"))
def test_odd_rows_and_empty_tables(spark, apply):
    docs = table(spark, ODD + [None], [0, 1, 2, 3, 4, 4, 6, 7, None]).withColumn("m", F.lit(1)).withColumn("comp", F.lit("x"))
    apply(docs).collect()
    assert apply(docs.limit(0)).count() == 0


def test_neardup_against_all_pairs(spark):
    base = [prose(60, i) for i in range(12)]
    texts = []
    for i, b in enumerate(base):
        texts.append(b)
        for k in range(4):
            w = b.split()
            for _ in range(k):
                w[R.randrange(len(w))] = "changed"
            texts.append(" ".join(w).upper())
    sets = [{tuple(t.lower().split()[j : j + 5]) for j in range(56)} for t in texts]
    up = list(range(len(texts)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                up[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["doc_id"]: r for r in neardup.components(table(spark, texts)).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert [got[i]["n_shingles"] for i in range(len(texts))] == list(map(len, sets))


def test_odd_sketch_estimates():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    for same in (950, 850, 700):
        b = np.unique(np.concatenate([a[:same], r.integers(0, 1 << 63, 1000 - same).astype(np.uint64)]))
        _, s = neardup.signatures([np.unique(a), b])
        true = same / (2000 - same)
        assert abs(neardup.sketch_similarity(int(np.bitwise_count(s[0] ^ s[1]).sum())) - true) < 0.2


def test_passages(spark):
    shared, other = prose(80, 100), prose(55, 101)
    fuzzy = shared.split()
    fuzzy[20], fuzzy[60] = "changed", "words"
    texts = [f"{prose(40, 1)} {shared} {prose(40, 2)}", f"{prose(90, 3)} {' '.join(fuzzy)} {prose(30, 4)}", f"{prose(50, 5)} {other}", f"{other} {prose(60, 6)}", prose(300, 7)]
    got = {r["doc_id"]: r for r in substring.passages(table(spark, texts)).collect()}
    assert set(got) == {1, 3}
    assert abs(got[1]["start"] - 90) <= 2 and abs(got[1]["n_words"] - 80) <= 3 and got[1]["ref_doc_id"] == 0 and got[1]["matched"] >= 76
    assert got[3]["start"] == 0 and abs(got[3]["n_words"] - 55) <= 1
    cut = {r["doc_id"]: r["text"] for r in substring.without_passages(table(spark, texts)).collect()}
    assert cut[0] == texts[0] and cut[4] == texts[4] and abs(len(cut[1].split()) - 120) <= 3


def test_passages_whose_parts_stand_in_earlier_documents(spark):
    texts = []
    for k in range(20):
        shared = prose(60, 200 + k).split()
        halves = [" ".join(shared[:30]), " ".join(shared[30:])]
        texts += [f"{prose(40, 300 + 10 * k + i)} {h} {prose(40, 400 + 10 * k + i)}" for i, h in enumerate(halves)]
        texts += [f"{prose(35 + k, 500 + 10 * k + i)} {' '.join(shared)} {prose(40, 600 + 10 * k + i)}" for i in range(2)]
    got = [r for r in substring.passages(table(spark, texts)).collect()]
    for k in range(20):
        mine = [r for r in got if r["doc_id"] == 4 * k + 3 and r["ref_doc_id"] == 4 * k + 2]
        assert len(mine) == 1 and abs(mine[0]["start"] - 35 - k) <= 1 and 60 <= mine[0]["n_words"] <= 62
    assert len(got) == 20


def test_chain_is_best_by_brute_force():
    for seed in range(30):
        r = random.Random(seed)
        m = sorted({(r.randrange(60), r.randrange(60)) for _ in range(12)})
        p, q = np.array([x for x, _ in m]), np.array([y for _, y in m])
        best = [float(substring.SEED)] * len(m)
        for i in range(len(m)):
            for j in range(len(m)):
                if p[j] < p[i] and q[j] < q[i] and j < i:
                    gap = substring.GAP_COST * (p[i] - p[j] + q[i] - q[j] - 2 * substring.SEED)
                    best[i] = max(best[i], best[j] + substring.SEED - gap)
        first = substring.chain(p, q)[0]
        steps = sum(substring.GAP_COST * (p[b] - p[a] + q[b] - q[a] - 2 * substring.SEED) for a, b in zip(first, first[1:]))
        assert abs(substring.SEED * len(first) - steps - max(best)) < 1e-9


def test_language_accuracy(spark):
    texts, langs = [], []
    for i in range(120):
        lang = ("xx", "yy", "zz")[i % 3]
        letters = {"xx": "aeioubcd", "yy": "qwrtzpéß", "zz": "жшщяюлкм"}[lang]
        r = random.Random(i)
        texts.append(" ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(30)))
        langs.append(lang)
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    model = langid.fit_documents(docs)
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    lang, score, _, rejected, _ = model.predict([texts[i] for i in held])
    assert lang == [langs[i] for i in held] and (score > 0.9).all() and not rejected.any()
    lang, _, _, rejected, _ = model.predict(["!!! 123", "漢字" * 200])
    assert lang[0] == "und" and rejected.all()


def test_language_model_sums_to_one(spark):
    docs = spark.createDataFrame([("aa", "abab abba baab"), ("bb", "bcbc ccbb")], "lang string, text string")
    model = langid.fit(docs)
    # Four characters occur; every other one of the alphabet has the probability of one that doesn't.
    alphabet = np.array([[ord(c)] for c in "abc " + "q"], np.uint32)
    for ctx in ("   ", "aba", " bc"):
        w = np.concatenate([np.tile(np.array([[ord(c)] for c in ctx], np.uint32), (1, 5)), alphabet.T], axis=0)
        p = np.exp(model.log_p(w).astype(float))
        assert np.allclose(p[:4].sum(axis=0) + (langid.ALPHABET - 4) * p[4], 1, atol=1e-3)


def test_language_model_against_plain_kneser_ney(spark):
    rows = [("aa", "Abba cab, abacab!"), ("aa", "bad cab 7 dab"), ("bb", "the cat; that hat"), ("bb", "a cab"), ("cc", "žluťoučký kůň")]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))

    def spelled(text):
        return f"   {' '.join(''.join(c if c.isalpha() else ' ' for c in text.lower()).split())} "

    def chance(lang):
        counts = [Counter() for _ in range(4)]
        for s in (spelled(t) for g, t in rows if g == lang):
            counts[3].update(s[i : i + 4] for i in range(len(s) - 3))
        for k in (2, 1, 0):
            counts[k].update(w[1:] for w in counts[k + 1])

        def p(w):
            if not w:
                return 1 / langid.ALPHABET
            after = [n for x, n in counts[len(w) - 1].items() if x[:-1] == w[:-1]]
            own, less = counts[len(w) - 1][w], langid.DISCOUNT
            return (max(own - less, 0) + less * len(after) * p(w[1:])) / sum(after) if after else p(w[1:])

        return p

    texts = ["Abba", "a cat in a cab", "žába", "qqq xyz", "that dab", "THE 12 the"]
    got, n = model.entropies(texts)
    for i, t in enumerate(texts):
        s = spelled(t)
        assert n[i] == len(s) - 3
        for j, lang in enumerate(model.langs):
            p = chance(lang)
            assert abs(got[i, j] + np.mean([np.log(p(s[k : k + 4])) for k in range(len(s) - 3)])) < 1e-4


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline

    copied = prose(70, 11)
    texts = [copied] * 150 + [prose(60 + i % 40, 2000 + i) for i in range(60)] + [None, "", "12 34", f"{prose(60, 3000)} {copied}"]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Texts without letters go, one of the copies stays, and the passage stays in its first document only.
    left = [0, *range(150, 210), 213]
    plain = {i: texts[i] for i in left} | {213: prose(60, 3000)}
    docs = table(spark, texts).where(F.col("doc_id").isin(left)).drop("text")
    docs = docs.join(spark.createDataFrame(list(plain.items()), "doc_id long, text string"), "doc_id").select("doc_id", "text", "lang", "source", "n_chars")
    enc, want = encoder(default_tokenizer()), Counter()
    for r in mixing.mixed(docs).collect():
        ids = enc.whole(r["text"].strip()) + np.array([2], "<u4").tobytes()
        want[r["doc_id"], len(ids) // 4, zlib.crc32(ids)] += 1
    assert max(n for _, n, _ in want) <= 1024  # one piece each
    assert Counter((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == want
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_packing(spark):
    r = random.Random(2)
    texts = [prose(r.randint(1, 900), i) for i in range(80)]
    rows = packing.pack(table(spark, texts)).collect()
    enc = encoder(default_tokenizer())
    by_doc = {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
    for i, t in enumerate(texts):
        ids = enc.whole(t) + np.array([2], "<u4").tobytes()
        at = 0
        for x in sorted(by_doc[i], key=lambda x: x["piece"]):
            assert x["start"] == at and zlib.crc32(ids[4 * at : 4 * (at + x["length"])]) == x["ids_crc32"]
            at += x["length"]
        assert at == len(ids) // 4
    bins = {}
    for x in rows:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 1024
    assert len(bins) <= -(-sum(x["length"] for x in rows) // 1024) * 1.05 + 1


def test_fullest_against_all_subsets():
    for seed in range(20):
        r = random.Random(seed)
        items = [r.randint(1, 30) for _ in range(8)]
        stock = np.bincount(items, minlength=41)
        got = packing.fullest(stock, 40)
        lead = max(items)
        rest = list(items)
        rest.remove(lead)
        best = max(s for s in (lead + sum(x for k, x in enumerate(rest) if m >> k & 1) for m in range(1 << 7)) if s <= 40)
        assert sum(got) == best and (np.bincount(got, minlength=41) <= stock).all()


def test_tokens_equal_the_library():
    enc = encoder(default_tokenizer())
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "é", "12", "²", "'s", "'LL", "...", "_", "<|endoftext|>", "中文", "🙂", "\x1c", "\x85", "\u3000"]
    r = random.Random(3)
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 20)))
        assert enc.encode(t) == enc.whole(t)


def test_tokens_encode_each_pretoken_once(monkeypatch):
    enc, asked = tokens.Encoder(default_tokenizer()), Counter()
    model_ids = enc.model_ids
    monkeypatch.setattr(enc, "model_ids", lambda p: asked.update([p]) or model_ids(p))
    w = prose(300, 1).split()
    text = " ".join(w) + ", ".join(w) + ".\nThe ".join(w) + " (" + ") (".join(w) + ") " + "!? ".join(w)
    for t in (text, text + " é", text):
        assert enc.encode(t) == enc.whole(t)
    assert max(asked.values()) == 1


def test_tokens_of_all_ascii_and_a_small_cache(monkeypatch):
    enc, r = tokens.Encoder(default_tokenizer()), random.Random(8)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 5000)
    monkeypatch.setattr(tokens, "_AT_ONCE", 7)
    for k in range(500):
        t = "".join(chr(r.randrange(128)) if r.random() < 0.6 else r.choice(" \n'aZ0.") for _ in range(r.randint(0, 60)))
        t += "x" * 300 if k % 50 == 0 else "\xa0²ü" if k % 3 == 0 else ""
        assert enc.encode(t) == enc.whole(t)
        assert enc.cache_bytes <= 5000 and max(map(len, enc.cache), default=0) <= tokens.LONGEST


def test_patterns_cut_alike():
    whole, basic, ascii_only = tokens._splitters()
    for x in (chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000):
        t = f"a{x}b {x}{x}1{x} {x}\n {x}'s{x}  {x}."
        assert whole(t) == basic(t) and (x > "\x7f" or whole(t) == ascii_only(t))


def test_sstable_round_trip_and_lookup(spark):
    texts = [prose(200, i) for i in range(300)] + [None]
    docs = table(spark, texts, [*range(0, 600, 2), None])
    from pipeweave.llm.common import shared_dir

    manifest = sstable.write(docs, shared_dir(spark), shards=3)
    rows = {r["doc_id"]: r for r in sstable.read(spark, manifest).collect()}
    enc, at = encoder(default_tokenizer()), 0
    for i, t in sorted(zip([*range(0, 600, 2), -1], texts)):
        ids = enc.whole(t or "") + np.array([2], "<u4").tobytes()
        r = rows[None if i < 0 else i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    readers = [sstable.Reader(m["path"]) for m in manifest]
    for i in (0, 302, 598):
        assert [x for r in readers for x in r.get(i)] == [enc.whole(texts[i // 2]) + np.array([2], "<u4").tobytes()]
    assert not any(r.get(i) for r in readers for i in range(1, 600, 2))


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(600, 24))
    v[10:40] = v[9]
    rows = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [1.0]), (None, rows[0][1])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    w = np.array([x for _, x in rows[:600]])
    s = np.stack([ann.cosines(np.broadcast_to(x, w.shape), w) for x in w[::20]])
    hit = 0
    for k, q in enumerate(range(0, 600, 20)):
        s[k, q] = -9
        want = sorted(range(600), key=lambda i: (-s[k, i], i))[:5]
        mine = [x["vec_id"] for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])]
        assert len(mine) == 5
        hit += len(set(want) & set(mine))
        if q == 20:
            assert mine == [9, 10, 11, 12, 13]
    assert hit >= 0.9 * 150
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert sorted((x["query_id"], x["rank"]) for x in ann.neighbours(few, F.col("vec_id") == 0).collect()) == [(0, 1), (0, 2)]


def test_toxicity_learns_pairs(spark):
    r = random.Random(1)
    texts, labels = [], []
    for i in range(800):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(prose(20, i) + (" fools" if a else "") + (" those" if b else ""))
        labels.append(int(a and b))
    docs = table(spark, texts)
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    machine = toxicity.fit(docs, marks.where("doc_id < 600"))
    got = {x["doc_id"]: x for x in toxicity.score(docs, machine).collect()}
    assert np.mean([got[i]["predicted"] == labels[i] for i in range(600, 800)]) > 0.95


def test_toxicity_learns_pairs_that_tell_nothing_alone(spark):
    r = random.Random(8)
    texts, labels = [], []
    for i in range(4000):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(prose(20, i) + (" fools" if a else "") + (" those" if b else ""))
        labels.append(int(a != b))
    docs = table(spark, texts)
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(docs, toxicity.fit(docs, marks.where("doc_id < 3000"))).collect()}
    assert np.mean([(got[i]["score"] > 0.5) == labels[i] for i in range(3000, 4000)]) > 0.9


def test_url_rules(spark):
    urls = ["https://WWW.example.net/en/1", "http://example.net/fr", "x://a.example.com/de/?q", "x://example.com/de", "http://notnet/", "net/", None, "x://a.org/fr/x#y", "x://a.net", "http://a.net?x://b.org/fr/", "http://a b.net/x", "x://.net/", "x://net\n/", "x://a\n.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlrules.judge(pages, urlrules.parse(["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"])).collect()}
    none = (None, "allow")
    net = ("net/", "block")
    assert [got[i] for i in range(14)] == [("example.net/en/", "allow"), net, ("example.com/de/", "block"), none, none, none, none, ("org/fr/", "allow"), none, none, net, net, none, net]
    assert urlrules.judge(pages, []).where("verdict = 'allow'").count() == 14
    many = urlrules.parse([f"block h{i}.example.org/p{i}/" for i in range(12_000)])
    one = spark.createDataFrame([(1, "x://a.h7.example.org/p7/"), (1, "x://a.h7.example.org/p7/"), (2, "x://h8.example.org/p7/")], "page_id long, url string")
    assert sorted(r["verdict"] for r in urlrules.judge(one, many).collect()) == ["allow", "block", "block"]


def test_mix_meets_targets(spark):
    docs = table(spark, [prose(R.randint(1, 50), i) for i in range(300)])
    rows = mixing.mix(docs).collect()
    for s in {(r["source_size"], r["target"]) for r in rows}:
        assert abs(sum(r["taken"] for r in rows if (r["source_size"], r["target"]) == s) - s[1]) <= 1
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    words = sum(len((r["text"] or "").split()) for r in mixing.mixed(docs).collect())
    assert words == sum(r["taken"] for r in rows)


def test_hosts(spark):
    bad, good = "w " * 40, prose(60, 1)
    rows = [(i, bad if i % 10 else good, "bad") for i in range(100)] + [(100 + i, good if i % 10 else bad, "good") for i in range(100)] + [(300, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in hostrules.judge(docs).where("kept").collect()}
    assert kept == {100 + i for i in range(100) if i % 10} | {300}


def test_language_counts_do_not_depend_on_merging(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "one two one two three"), ("b", "uno dos uno"), ("a", "one"), ("b", ""), ("a", "12 34")], "lang string, text string")

    def counted():
        return sorted((r["lang"], r["hi"], r["lo"], r["n"]) for r in langid.count(rows.coalesce(1)).groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")).collect())

    whole = counted()
    monkeypatch.setattr(langid, "MERGE_ROWS", 1)
    monkeypatch.setattr(langid, "_batches", lambda column, limit=1: ((i, [x.as_py()]) for i, x in enumerate(column)))
    assert counted() == whole and len(whole) > 10


@pytest.mark.parametrize(("held", "then"), [("64m", 4 << 20), ("67108864b", 4 << 20), ("1MB", 1 << 20), ("1000", 1000)])
def test_arrow_batches_are_bounded(spark, held, then):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, held)
        with common.small_batches(spark):
            assert spark.conf.get(key) == str(then)
        assert spark.conf.get(key) == held
    finally:
        spark.conf.set(key, before)


def test_pipeline_drops_near_copies_from_80_percent(spark):
    import corpus_pipeline

    texts = []
    for i in range(30):  # one word changed inside 55 of them: 46 shingles of 56 are shared, 0.82
        w = prose(55, 900 + i).split()
        texts.append(" ".join(w))
        w[20 + i % 10] = "changed"
        texts.append(" ".join(w))
    kept = corpus_pipeline.near_duplicates(spark, table(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 60, 2))
    missed = lambda p: (1 - (p / 100) ** neardup.ROWS) ** neardup.bands_for(p)
    assert neardup.bands_for(85) == neardup.BANDS and missed(80) <= missed(85)


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    q = rng.normal(size=16)
    rows = [(0, q.tolist())]
    rows += [(1, (q + rng.normal(size=16) * 0.01).tolist()) for _ in range(30)]  # one id, many vectors
    rows += [(i, (q + rng.normal(size=16) * 0.1).tolist()) for i in range(2, 6) for _ in range(1)] * 4
    rows += [(i, rng.normal(size=16).tolist()) for i in range(6, 40)]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.neighbours(x, F.col("vec_id") == 0).orderBy("rank").collect()
    best = {}
    for i, v in rows[1:]:
        best[i] = max(best.get(i, -2.0), float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)))
    assert [r["vec_id"] for r in got] == sorted(best, key=lambda i: -best[i])[:5]
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rows = [(0, [1.0, 1.0]), (1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 0.0])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert {r["vec_id"] for r in got[:2]} == {1, 2} and got[2]["vec_id"] == 3 and all(abs(r["score"] - 1) < 1e-15 for r in got[:2])


def test_toxicity_scores_do_not_depend_on_sampling_rates(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 200)
    r = random.Random(4)
    # "bad" stands in every toxic text and in a quarter as many of the clean: its share of toxic ones is 0.31.
    rows = [(i, f"{prose(8, i)} {'bad' if i % 10 == 0 or r.random() < 0.25 else 'good'}", int(i % 10 == 0)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = toxicity.score(docs, machine).agg(F.avg("score"), F.avg("predicted")).first()
    assert abs(got[0] - 0.1) < 0.05 and got[1] < 0.05


def test_language_model_keeps_every_ngram(spark, monkeypatch):
    r = random.Random(6)
    rows = [("zh", "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(10_000))) for _ in range(28)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    grams = {t[i : i + 4] for t in (f"   {t} " for _, t in rows) for i in range(len(t) - 3)}
    assert len(model.parts[0].probs[langid.ORDER - 1][0]) == len(grams) > 1 << 18
    # Rows that could calibrate but aren't sampled are counted.
    monkeypatch.setattr(langid, "CALIBRATION_ROWS", 10)
    few = spark.createDataFrame([("aa", "abab abba")], "lang string, text string")
    more = spark.createDataFrame([("aa", f"qz{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(100)], "lang string, text string")
    assert len(langid.fit(few, more).parts[0].probs[langid.ORDER - 1][0]) > len(langid.fit(few).parts[0].probs[langid.ORDER - 1][0]) + 80


def test_passages_beyond_the_first_holder(spark):
    shared = prose(120, 700).split()
    part = lambda a, b: " ".join(shared[a:b])
    texts = [
        f"{prose(40, 701)} {part(5, 50)} {prose(40, 702)} {part(70, 115)} {prose(40, 703)}", f"{prose(45, 704)} {' '.join(shared)} {prose(45, 705)}",
        f"{prose(35, 706)} {' '.join(shared)} {prose(35, 707)}",
    ]
    got = [r for r in substring.passages(table(spark, texts)).collect() if r["doc_id"] == 2]
    covered = {i for r in got for i in range(r["start"], r["start"] + r["n_words"])}
    assert covered >= set(range(35, 155)) and len(covered) <= 125


def test_every_exact_passage_is_covered_by_brute_force(spark):
    r = random.Random(9)
    pool = [prose(r.randint(20, 90), 800 + i).split() for i in range(12)]
    texts = []
    for i in range(40):  # parts of shared pieces, one after another, some of them repeated in one text
        words = []
        for _ in range(r.randint(1, 5)):
            p = r.choice(pool)
            a = r.randint(0, len(p) // 3)
            words += p[a : a + r.randint(15, 90)] * r.choice((1, 1, 1, 2)) + prose(r.randint(0, 30), r.random()).split()
        texts.append(" ".join(words))
    texts += ["x y " * 200, "x y " * 100 + prose(40, 1), texts[3], texts[3]]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = t.split()
        windows = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        want[i] = {k + j for k, x in enumerate(windows) if x in seen for j in range(50)}
        seen |= set(windows)
    rows = substring.passages(table(spark, texts)).collect()
    for i in range(len(texts)):
        covered = {k for r in rows if r["doc_id"] == i for k in range(r["start"], r["start"] + r["n_words"])}
        assert want[i] <= covered, (i, sorted(want[i] - covered)[:5])
    assert len({(x["doc_id"], x["start"], x["n_words"], x["ref_doc_id"], x["ref_start"]) for x in rows}) == len(rows)
    assert all(x["n_words"] <= len(texts[x["doc_id"]].split()) - x["start"] for x in rows)


def test_gaps_are_aligned_whole():
    r = random.Random(1)
    for n in (0, 1, 30, 70, 300):
        a = [r.randint(0, 5) for _ in range(n)]
        b = [x for x in a if r.random() < 0.75]
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                keep = row[j + 1]
                row[j + 1] = last + 1 if x == y else max(keep, row[j])
                last = keep
        assert substring._gap(a, b) == row[-1] == len(b)
    assert substring.merged([(0, 60, 5, 60, 50), (0, 60, 5, 60, 50), (40, 60, 45, 60, 55), (300, 50, 0, 50, 50)]) == [(0, 100, 5, 100, 85), (300, 50, 0, 50, 50)]


CLASHES = ("left", "target", "copies", "prefix", "tie", "source_size", "size", "taken", "state", "row", "h", "s", "of", "n", "lost", "start", "n_words", "rep", "salt", "fp_a", "comp", "key", "c0", "a.b", "x`y")


def test_stages_keep_columns_of_any_name_and_defined_values(spark):
    import corpus_pipeline

    copy, long = prose(80, 1), "word " * 3000 + prose(2000, 2)
    texts = [copy, copy.upper(), prose(70, 3), None, "", long, prose(90, 4), f"{prose(60, 5)} {copy}"]
    docs = table(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7])
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(7))
    docs = common.materialize(docs)
    deduplicated = corpus_pipeline.near_duplicates(spark, docs, "")
    rows = {r["doc_id"]: r for r in deduplicated.collect()}
    assert deduplicated.columns == docs.columns and set(rows) == {0, 2, 3, 4, 5, 6, 7} and all(r[c] == 7 for r in rows.values() for c in CLASHES)
    cut = corpus_pipeline.passages(spark, common.materialize(deduplicated), "")
    rows = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut.columns == docs.columns and len(rows[7].split()) in range(58, 61) and all(rows[i] == texts[i] for i in (0, 2, 3, 4, 5, 6))
    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns and {r["a.b"] for r in mixed.collect()} == {7}
    kept = corpus_pipeline.identify(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 1, 2, 5, 6, 7}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").collect() == []


def test_readers_of_few_columns_get_all_rows(spark):
    docs = table(spark, [prose(R.randint(1, 1500), i) for i in range(40)] + [None, prose(5, 1)])
    for apply in (packing.pack, neardup.components, substring.passages, mixing.mix, hostrules.judge, sstable.write_and_read):
        out = apply(docs)
        n = len(out.collect())
        assert out.count() == n == len(out.select("doc_id").collect()) == sum(r["count"] for r in out.groupBy("doc_id").count().collect()), apply


def test_hot_bucket_of_many_components(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    base = prose(60, 50).split()
    texts = []
    for i in range(60):  # edits of one text: some pairs link, many are just below
        w = list(base)
        for _ in range(R.randint(0, 2)):
            w[R.randrange(60)] = f"changed{i}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(56)} for t in texts]
    up = list(range(60))
    find = lambda i: i if up[i] == i else find(up[i])
    for i in range(60):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                up[max(find(i), find(j))] = min(find(i), find(j))
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(table(spark, texts)).collect()}
    assert [got[i] for i in range(60)] == [find(i) for i in range(60)]


def test_language_counts_and_limits_come_from_all_learnt_rows(spark):
    alike = lambda i: zlib.crc32(str(i).encode()) % 4
    r = random.Random(8)
    rows = [(i, " ".join("".join(r.choice("aeioubcd") for _ in range(5)) for _ in range(30)), "xx") for i in range(400)]
    # One word a row, of letters of its own, shows whether the row is counted.
    rows = [(i, f"{t} {chr(0x4E00 + i) * 4}", g) for i, t, g in rows]
    # Odd texts of each fold widen the limit of their language; before, those of two folds were only counted.
    odd = [(1000 + i, " ".join("".join(r.choice("mnpqrstvwxyz") for _ in range(5)) for _ in range(30)), "xx") for i in range(40) if alike(1000 + i) in (0, 1)]
    schema = "doc_id long, text string, lang string"
    model, wide = (langid.fit_documents(spark.createDataFrame(x, schema)) for x in (rows, rows + odd))
    w = np.array([[0x4E00 + i] * 4 for i in range(400)], np.uint32).T
    _, found = langid._look_up(model.parts[0].probs[langid.ORDER - 1][0], langid.ngram_hash(w))
    assert found.tolist() == [alike(i) != 2 for i in range(400)]
    (mean, sd, top), (mean2, sd2, top2) = model.limits[0], wide.limits[0]
    assert mean2 + sd2 * top2 > mean + sd * top + 1


def test_accepted_calibrates_on_every_learnt_row(spark):
    calls = []
    r = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join("".join(r.choice("aeioubcd") for _ in range(5)) for _ in range(30)), "xx") for i in range(200)], "doc_id long, text string, lang string")
    plain = langid._limit
    langid._limit = lambda model, z: (calls.append(z.count()), plain(model, z))[1]
    try:
        assert langid.accepted(docs).count() == 200
    finally:
        langid._limit = plain
    assert calls == [sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(200))]


def test_pipeline_learns_languages_from_every_labelled_document(spark, monkeypatch):
    import corpus_pipeline

    calls, plain = [], langid._limit
    monkeypatch.setattr(langid, "_limit", lambda model, z: (calls.append(z.count()), plain(model, z))[1])
    r = random.Random(13)
    drawn = lambda letters: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(30))
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    # The documents of one language all lie in the fold that op2 holds out; those of a third have no label.
    rows = [(i, drawn("жшщяюлкм"), "zz") if fold(i) == 2 else (i, drawn("aeioubcd"), "xx") for i in range(200)]
    docs = spark.createDataFrame(rows + [(200 + i, drawn("漢字語文書"), None) for i in range(4)], "doc_id long, text string, lang string")
    assert sorted(x["doc_id"] for x in corpus_pipeline.identify(spark, docs, "").collect()) == list(range(200))
    assert calls == [200]


def test_fuzzy_passages_beyond_the_first_holder(spark):
    texts = []
    for k in range(6):
        shared = prose(90, 4000 + k).split()
        # Two documents hold a third of it each; then two hold all of it, the later one with each 15th word changed.
        texts += [f"{prose(40, 4100 + 10 * k + i)} {' '.join(shared[a : a + 30])} {prose(40, 4200 + 10 * k + i)}" for i, a in enumerate((0, 30, 60))]
        texts.append(f"{prose(30, 4300 + k)} {' '.join(shared)} {prose(30, 4400 + k)}")
        shared[7::15] = [f"new{k}x{i}" for i in range(6)]
        texts.append(f"{prose(35, 4500 + k)} {' '.join(shared)} {prose(35, 4600 + k)}")
    got = substring.passages(table(spark, texts)).collect()
    for k in range(6):
        covered = {i for r in got if r["doc_id"] == 5 * k + 4 and r["ref_doc_id"] == 5 * k + 3 for i in range(r["start"], r["start"] + r["n_words"])}
        assert covered >= set(range(43, 117)) and len(covered) <= 96
