"""Each corpus operator against a plain version on small tables, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
import xxhash

from docql.llm import bpe, components, decontaminate, html, langid, linededup, maxscore, pii, ppm, shards, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FILES = pytest.importorskip("public_tokenizers")


def docs(spark, texts, langs=None, extra=""):
    rows = [(i, t, (langs or {}).get(i, "en"), "s", 0) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def made(seed, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choice(["the", "of", "a", "alpha", "beta", "gamma", "delta", "Éa", "x9"]) for _ in range(r.randrange(1, 40))) for _ in range(n // 2)]
    out = []
    for i in range(n):
        t = r.choice(base).split()
        if r.random() < 0.4 and t:
            t[r.randrange(len(t))] = "changed%d" % r.randrange(4)
        out.append((i, " ".join(t)))
    return [*out, (n, None), (n + 1, ""), (n + 2, "   \n"), (n + 3, "word"), (n + 4, "###")]


# 1


def test_feistel_permutes_and_returns():
    f = pii.Feistel(b"key")
    for n in (1, 2, 3, 10, 97, 1000):
        seen = [f.permute(b"x", i, n) for i in range(n)]
        assert sorted(seen) == list(range(n))
        assert all(f.permute(b"x", y, n, back=True) == i for i, y in enumerate(seen))


def test_pseudonyms_link_keep_formats_and_return(spark):
    text = "4111111111111111 4111-1111-1111-1111 4111111111111112 bob.smith7@mail.org BOB.SMITH7@MAIL.ORG 2024-02-29 2024-02-30 5.1.2024 31/12/1999 192.168.1.254 999.1.1.1 +1 (017) 555-7713 DE89 3704 0044 0532 0130 00 078-05-1120"
    df = docs(spark, [(1, text), (2, "again 4111111111111111"), (3, None), (4, "")]).withColumnRenamed("source", "pii")
    done = pii.pseudonyms(df, "k")
    got = {r.doc_id: r for r in done.collect()}
    new = got[1].text.split(" ")
    assert new[2] == "4111111111111112" and "2024-02-30" in new and "999.1.1.1" in new
    assert pii.luhn(new[0]) and new[0] != "4111111111111111" and new[1].replace("-", "") == new[0]
    assert new[3].upper() == new[4] and new[3] != "bob.smith7@mail.org"
    assert got[2].text == f"again {new[0]}" and got[3].text is None and got[4].text == ""
    assert [s.kind for s in got[1].pii] == ["card", "card", "email", "email", "date", "date", "date", "ip", "phone", "iban", "ssn"]
    back = {r.doc_id: r.text for r in pii.pseudonyms(done.drop("pii"), "k", back=True).collect()}
    assert back[1] == text
    assert pii.pseudonyms(df.limit(0), "k").count() == 0


def test_pseudonyms_of_one_number_in_any_layout():
    f = pii.Feistel(b"key")
    digits = lambda t: "".join(c for c in t if c.isdigit())
    new = [pii.pseudonymise(t, f)[0] for t in ("+1 017 555 7713", "+10175557713", "+1 (017) 555-7713", "(017) 555-7713", "017.555.7713", "tel. 017-555-7713.")]
    assert len({digits(t)[-10:] for t in new}) == 1 and digits(new[0]) != "10175557713"
    for text, kinds in (("AT61 1904 3002 3457 3201 2024-05-01", ["iban", "date"]), ("ES91 2100 0418 4502 0005 1332 A", ["iban"]), ("+1 (017) 555-7713 16 people", ["phone"]), ("+49 30 123456 and 1-1-1", ["phone"]), ("017-555-77131 and +1 23 45", [])):
        new, spans = pii.pseudonymise(text, f)
        assert [s[0] for s in spans] == kinds and (new != text or not kinds) and len(new) == len(text)
        assert pii.pseudonymise(new, f, back=True)[0] == text
    assert pii.pseudonymise("+1 (017) 555-7713 16 people", f)[0].endswith(" 16 people")


# 2


def brute_contamination(texts, items, window=8):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in texts:
        w, hit, found = cut(t), set(), set()
        for k, item in items:
            v = cut(item)
            n = min(window, len(v))
            for s in range(len(v) - n + 1) if v else []:
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(k))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_against_all_windows(spark, seed):
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice("a b c d E9 ü the".split()) for _ in range(n))
    items = [(10, some(12)), (9, some(8)), (100, some(3)), (11, "b"), (12, None), (13, "-- "), (14, some(20)), (15, "the the the the the the the the the")]
    items = [x for x in items if x[1]]
    texts = [(i, some(r.randrange(60)) + " " + r.choice(items)[1] * r.randrange(2) if r.random() < 0.8 else some(200)) for i in range(40)]
    texts += [(50, None), (51, ""), (52, "the " * 30)]
    bench = spark.createDataFrame([*items, (12, None), (13, "-- ")], "item_id long, text string")
    df = docs(spark, texts)
    got = {x.doc_id: tuple(x)[1:6] for x in decontaminate.contamination(df, bench).collect()}
    assert got == brute_contamination(texts, items)
    again = {x.doc_id: tuple(x)[1:6] for x in decontaminate.contamination(df.union(df), bench).collect()}
    assert again == got
    clean = {x.doc_id for x in decontaminate.clean(df, bench).collect()}
    assert clean == {i for i, x in got.items() if x[2] == 0}
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert {x.n_items for x in decontaminate.contamination(df, bench.limit(0)).collect()} == {0}


@pytest.mark.parametrize("width", [3, 6])
def test_proximity_against_all_places(spark, width):
    r = random.Random(width)
    texts = [(1, "x alpha y beta z"), (2, "alpha a b c d e f beta"), (3, "beta alpha"), (4, None), (5, "")]
    texts += [(10 + i, " ".join(r.choice("alpha beta gamma d e".split()) for _ in range(r.randrange(30)))) for i in range(40)]
    items = [(1, "alpha beta"), (2, "gamma"), (3, "alpha gamma alpha beta"), (4, "missing beta")]
    phrases = decontaminate.phrase_words(spark.createDataFrame(items, "item_id long, text string"), 8)
    index = decontaminate.postings(docs(spark, texts), phrases)
    ids = phrases.select("ik", "item_id").distinct()
    got = {(x.doc_id, x.item_id, x.start) for x in decontaminate.proximity_matches(index, phrases, decontaminate.frequencies(index), width).join(ids, "ik").collect()}
    cut = {i: (t or "").split() for i, t in texts}
    assert got == {(i, k, s) for i, w in cut.items() for k, t in items for s in range(len(w)) if w[s] in t.split() and set(t.split()) <= set(w[s : s + width])}


def test_documents_without_id_are_cleaned(spark):
    leak = "alpha beta gamma delta epsilon zeta eta theta iota"
    df = docs(spark, [(1, leak), (2, "fine"), (None, leak + " more"), (None, "fine too"), (None, None)])
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert sorted((x.doc_id or 0, x.text or "") for x in decontaminate.clean(df, bench).collect()) == [(0, ""), (0, "fine too"), (2, "fine")]


def test_bits_keep_all_documents_wanted(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 64)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 256)
    index = spark.range(3000).selectExpr("id doc_id", "id pos")
    wanted = spark.range(0, 3000, 150).selectExpr("id doc_id")
    got = [x.doc_id for x in decontaminate.of_documents(index, wanted).collect()]
    assert len(got) == len(set(got)) < 1500 and set(range(0, 3000, 150)) <= set(got)


# 3


def plain_bits(sample: bytes, text: str) -> float:
    """Longest matches by search in the sample, block by block; a byte that the sample lacks is a phrase of its own."""
    raw, phrases = langid.letters(text), 0
    for start in range(0, len(raw), langid.BLOCK):
        at, part = 0, raw[start : start + langid.BLOCK]
        while at < len(part):
            n = 0
            while at + n < len(part) and part[at : at + n + 1] in sample:
                n += 1
            at += max(1, n)
            phrases += 1
    return phrases * math.log2(max(2, len(sample)))


SCRIPTS = {"ja": "日本語の文章をここに書きますとても長いので", "zh": "这是一个用中文写成的句子我们没有别的意思", "ru": "широкая электрификация южных губерний даст", "el": "ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "en": "the quick brown fox jumps over"}


def test_automaton_parses_longest_matches():
    r = random.Random(5)
    for k in range(30):
        a, b = ("abc é", "bcd ü") if k % 2 else (SCRIPTS["ja"], SCRIPTS["zh"] + SCRIPTS["ru"])
        samples = {"a": "".join(r.choice(a) for _ in range(30)), "b": "".join(r.choice(b) for _ in range(30))}
        model = langid.Model({x: langid.letters(t) for x, t in samples.items()})
        texts = ["".join(r.choice(a + b + "z1!") for _ in range(r.randrange(700))) for _ in range(4)] + ["", "12"]
        found = model.predict(texts)
        for text, got, said in zip(texts, model.costs(texts), found, strict=True):
            want = [plain_bits(model.samples[lang], text) for lang in model.langs]
            if not any(c.isalpha() for c in text):
                assert said == ("und", 0.0)
                continue
            assert got.tolist() == pytest.approx(want)
            assert said == (model.langs[want.index(min(want))], pytest.approx(1 - min(want) / max(want)))


def test_ties_go_to_the_first_name():
    model = langid.Model({"b": b"same letters", "a": b"same letters", "c": b"xyz"})
    assert model.predict(["same", "letters same", "q"]) == [("a", 0.0), ("a", 0.0), ("c", pytest.approx(1 - math.log2(3) / math.log2(12)))]
    assert langid.Model({}).predict(["x", None]) == [("und", 0.0)] * 2


def test_many_scripts_are_told_apart(spark):
    r = random.Random(2)
    text = lambda lang, n: "".join(r.choice(SCRIPTS[lang]) for _ in range(n))
    rows = [(i, text(lang, r.randrange(20, 90)), lang) for i in range(200) for lang in [sorted(SCRIPTS)[i % 5]]]
    rows += [(1000 + i, "ein wort " * 9_000, "long") for i in range(3)] + [(7, "same id", None)] * 30
    got = {x.doc_id: x.lang_pred for x in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == lang for i, _, lang in rows if lang and i != 7)
    assert langid.sample_bytes(4) == langid.SAMPLE_BYTES and 200 * langid.sample_bytes(200) * langid.TABLE_COST <= langid.TABLE_BYTES


def test_language_identification(spark):
    r = random.Random(7)
    words = {"xx": "lorem ipsum dolor sit amet".split(), "yy": "der hund läuft über straße".split()}
    rows = [(i, " ".join(r.choice(words[l]) for _ in range(r.randrange(3, 30))), l) for i in range(200) for l in ["xx", "yy"][i % 2 : i % 2 + 1]]
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "123 !?", None), (903, "ipsum", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in langid.identify(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i].lang_pred == l for i, t, l in rows if t and l and any(c.isalpha() for c in t))
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in langid.identify(df.where("lang is null")).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


# 4


def test_maxscore_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 6) / 7]) for i in rng.permutation(260)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400, None), (450, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (550, [float("inf")] * 6), (600, [0.0] * 6)]
    df = spark.createDataFrame([*rows, rows[1]], "vec_id long, embedding array<float>")
    got = sorted(tuple(x) for x in maxscore.top_vectors(df).collect())
    ints = {i: np.floor(256 * np.float32(v).astype(float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in ints:
        if q % 50 == 0:
            best = sorted((-int(ints[q] @ w), i) for i, w in ints.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == sorted(want)
    pairs = df.select(maxscore.F.col("vec_id").alias("id"), maxscore.weights(maxscore.F.col("embedding")).alias("w"))
    assert sorted(tuple(x) for x in maxscore.search(pairs.where("id % 50 = 0"), pairs, shard_rows=7, block_queries=2).collect()) == sorted(want)
    clashing = df.withColumns({c: maxscore.F.lit(c) for c in ("id", "w", "block", "shard", "rank", "score", "query_id")})
    assert sorted(tuple(x) for x in maxscore.top_vectors(clashing).collect()) == sorted(want)
    assert maxscore.top_vectors(df.where("vec_id = 50")).count() == 0 and maxscore.top_vectors(df.limit(0)).count() == 0


def test_shards_of_sparse_lists_prune_rightly(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    for trial in range(40):
        monkeypatch.setattr(maxscore, "LIST_BLOCK", int(rng.integers(1, 80)))
        w = rng.integers(-6, 7, (int(rng.integers(1, 200)), 8))
        w[rng.random(w.shape) < (0.6 if trial % 2 else 0)] = 0
        ids = rng.permutation(1000)[: len(w)]
        shard = maxscore.Shard(ids, np.nonzero(w)[1], w[w != 0], (w != 0).sum(1))
        if shard.lists:
            query = {i: int(x) for i, x in enumerate(w[0]) if x}
            want = sorted((-int(s), int(i)) for s, i in zip(w @ w[0], ids) if i != ids[0])[:5]
            assert [(-s, i) for s, i in shard.best(query, int(ids[0]))] == want
            if want:
                least = -want[int(rng.integers(len(want)))][0]
                assert [(-s, i) for s, i in shard.best(query, int(ids[0]), least=least) if s >= least] == [x for x in want if -x[0] >= least]
                if maxscore.Together.fits(shard, [query]):
                    for floor in (None, least):
                        got = maxscore.Together(shard, [query, {0: 0}]).best([int(ids[0]), -1], [floor, None], 5)[0]
                        assert [(-s, i) for s, i in got if floor is None or s >= floor] == [x for x in want if floor is None or -x[0] >= floor]


# 5


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(shards, "ROWS_PER_CELL", 3)
    monkeypatch.setattr(shards, "REPEATS_PER_ROW", 4)
    rows = [*[(i, f"text {i % 7} ü") for i in range(300)], *[(77, "again")] * 50, *[(None, f"nameless {i}") for i in range(40)], (300, None), (301, ""), (5, "text 5 ü"), (None, "no id")]
    got = shards.shard_documents(docs(spark, rows), shards=8).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    heavy = Counter(r.shard for r in shards.shard_documents(docs(spark, rows), shards=2, weights=[3.0, 1.0, 1.0]).collect())
    assert heavy[0] > 2 * heavy[1]
    assert shards.shard_documents(docs(spark, rows).limit(0)).count() == 0


# 6


def test_patience_aligns():
    r = random.Random(3)
    for _ in range(2000):
        a, b = ([r.randrange(8) for _ in range(r.randrange(12))] for _ in range(2))
        p = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in p) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
    assert linededup.patience([1, 2, 3, 9, 4], [1, 5, 2, 3, 4]) == [(0, 0), (1, 2), (2, 3), (4, 4)]


def test_line_dedup_against_plain_pairs(spark):
    r = random.Random(11)
    pool = [" ".join(r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(r.randrange(1, 9))) for _ in range(14)] + ["", " "]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 9)))) for i in range(50)]
    rows += [(60, None), (61, ""), (62, rows[3][1]), (62, rows[3][1]), (None, rows[4][1])]
    df = docs(spark, rows).withColumnRenamed("source", "n_removed")
    got = Counter((x.doc_id, x.text) for x in linededup.dedup_lines(df).collect())
    lines = {i: [x.strip(" ") for x in t.split("\n")] for i, t in rows if t is not None and i is not None}
    first = {}
    for i in sorted(lines):
        for x in lines[i]:
            first.setdefault(x, i)
    want = Counter()
    for i, t in rows:
        if i is None or t is None:
            want[i, t] += 1
            continue
        gone = set()
        words = [len(x.split()) for x in lines[i]]
        for k in {first[x] for x in lines[i] if x and first[x] < i}:
            gone |= set(plain_repeated(lines[k], lines[i], words, linededup.MIN_WORDS))
        want[i, "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone)] += 1
    assert got == want
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def plain_patience(a, b):
    """Patience diff from its description, by recursion: common ends, then unique common lines in their longest order, of equals the one that ends last."""
    if a and b and a[0] == b[0]:
        return [(0, 0), *((i + 1, j + 1) for i, j in plain_patience(a[1:], b[1:]))]
    if a and b and a[-1] == b[-1]:
        return [*plain_patience(a[:-1], b[:-1]), (len(a) - 1, len(b) - 1)]
    both = [(a.index(x), j) for j, x in enumerate(b) if a.count(x) == 1 and b.count(x) == 1]
    longest: list[list] = []  # the best chain that ends with each pair
    for k, (i, j) in enumerate(both):
        longest.append(max((longest[h] for h in reversed(range(k)) if both[h][0] < i), key=len, default=[]) + [(i, j)])
    chain = max(reversed(longest), key=len, default=[])
    if not chain:
        return []
    out, at, bt = [], 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        out += [(at + x, bt + y) for x, y in plain_patience(a[at:i], b[bt:j])]
        if i < len(a):
            out.append((i, j))
        at, bt = i + 1, j + 1
    return out


def plain_repeated(a, b, words, least):
    """The lines of b in runs of aligned lines, next to each other in both, of at least so many words."""
    pairs, runs = plain_patience(a, b), []
    for i, j in pairs:
        if runs and runs[-1][-1] == (i - 1, j - 1):
            runs[-1].append((i, j))
        else:
            runs.append([(i, j)])
    return [j for run in runs if sum(words[j] for _, j in run) >= least for _, j in run]


def test_patience_against_its_description():
    r = random.Random(13)
    for _ in range(3000):
        a, b = ([r.randrange(10) for _ in range(r.randrange(14))] for _ in range(2))
        words = [r.randrange(7) for _ in b]
        got, want = linededup.patience(a, b), plain_patience(a, b)
        assert got == want and linededup.repeated(a, b, words) == plain_repeated(a, b, words, linededup.MIN_WORDS)


def every_pair(rows, least=linededup.MIN_WORDS):
    """Each text without what alignment with any earlier one deletes; lines that don't go stay as they are."""
    out, ids = {}, sorted(rows)
    cut = {i: [x.strip(" ") for x in rows[i].split("\n")] for i in ids}
    for i in ids:
        words, gone = [len(x.split()) for x in cut[i]], set()
        for k in ids:
            if k < i:
                gone |= set(plain_repeated(cut[k], cut[i], words, least))
        out[i] = "\n".join(x for j, x in enumerate(rows[i].split("\n")) if j not in gone)
    return out


def test_windows_make_up_every_run():
    r = random.Random(8)
    for _ in range(500):
        words, least = [r.randrange(7) for _ in range(r.randrange(14))], r.randrange(1, 9)
        spans = linededup.windows(words, least)
        for s in range(len(words)):
            for e in range(s + 1, len(words) + 1):
                inside = {j for a, b in spans if s <= a and b <= e for j in range(a, b)}
                assert inside == (set(range(s, e)) if sum(words[s:e]) >= least else set())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_against_every_earlier_document(spark, seed):
    from corpus_pipeline import line_dedup

    x, y, z = "a b c d e f", "g h i j k l", "m n o p q r"
    order = [(1, f"{x}\n{y}"), (2, f"{y}\n{x}"), (3, f"{y}\n{x}"), (4, "s t u"), (5, "v w\nq"), (6, "s t u\nv w"), (7, "s t u\nv w"), (8, f"{z}\nno\n{z}"), (9, f"{z}\nyes\n{z}"), (10, f"{z}\nyes\n{z}")]
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcdefgh") * r.randrange(1, 3) for _ in range(r.randrange(1, 9))) for _ in range(9)] + ["", " "]
    rows = order if seed == 1 else [(i, "\n".join(r.choice([*pool, f"only {i} {k}"]) for k in range(r.randrange(1, 11)))) for i in range(70)]
    got = {d.doc_id: d.text for d in linededup.dedup_lines(docs(spark, rows), partners="every").collect()}
    assert got == every_pair(dict(rows))
    assert {d.doc_id: d.text for d in line_dedup(spark, docs(spark, rows), "").collect()} == {i: t for i, t in got.items() if t == dict(rows)[i] or t.split()}
    if seed == 1:
        assert got[3] == got[7] == ""


# 7


def plain_simhash(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, linked):
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in nodes}


def test_simhash_against_all_pairs(spark):
    texts = made(2, 120)
    texts += [(300 + i, t) for i, t in texts[:5]] + [(400, "long " * 700)]
    prints = {i: plain_simhash(t) for i, t in texts}
    ids = sorted(prints)
    roots = union(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])
    df = docs(spark, texts)
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df.union(df.limit(3))).collect()}
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in ids}
    assert sorted(x.doc_id for x in simhash.first_of_each(df.union(df.limit(3))).collect()) == sorted(set(roots.values()))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_unrelated_texts_of_one_doc_id_both_stay(spark):
    r = random.Random(4)
    a, b, c = (" ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(40)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (4, c), (4, a), (5, None), (5, ""), (None, a)]
    got = sorted(((x.doc_id or 0, x.text or "") for x in simhash.first_of_each(docs(spark, rows)).collect()))
    assert got == sorted([(0, a), (1, a), (2, b), (4, c), (5, "")])


def test_ball_hashing_finds_all_within_radius(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << k for k in r.sample(range(64), d)) for b in base for d in (1, 2, 3, 3, 3, 4, 5, 6)]
    values = sorted({*base, *near})
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    assert all((signed[x.a] ^ signed[x.b]).bit_count() <= 3 for x in found)
    want = union(values, [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= 3])
    assert union(values, [(signed[x.a], signed[x.b]) for x in found]) == want


def test_variants_sent_grow_with_fingerprints(spark):
    r = random.Random(3)
    prints = [(r.getrandbits(64) - (1 << 63),) for _ in range(1600)]
    whole = spark.createDataFrame(prints, "fp long")
    rows = {}
    for n in (400, 1600):
        df = spark.createDataFrame(prints[:n], "fp long")
        for fan in (1_000_000, 8):  # in one step, and in as many as it takes
            sent = simhash.sent(df, n, group_variants=2_000, fan=fan).collect()
            rows[n, fan] = len(sent)
            met = {x for row in sent for x in simhash.unpacked([memoryview_of(row.packed)])[0].tolist()}
            assert met == set(simhash.variants(simhash.np.array([p for p, in prints[:n]], simhash.np.int64).view(simhash.np.uint64))[0].tolist())
            places: dict[int, int] = {}
            assert all(places.setdefault(v, row.part) == row.part for row in sent for v in simhash.unpacked([memoryview_of(row.packed)])[0].tolist())
    assert rows[1600, 8] <= 5 * rows[400, 8] and whole.count() == 1600


def memoryview_of(raw):
    import pyarrow as pa

    return pa.scalar(bytes(raw), pa.binary())


@pytest.mark.parametrize("few", [100_000, 0])
def test_components(spark, few):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (95, 100), (7, 7), (None, 3)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(chain, "a long, b long"), few).collect()}
    assert components.components(spark.createDataFrame([], "a long, b long"), few).count() == 0
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


# 8


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = FILES.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = ["", " ", "Hello World", "ΣΑΣ İstanbul", "a<|endoftext|>B <|startoftext|>", "éé 日本語 ½ Ⅷ", "😀👍🏽 x", "don't I'LL", "ab" * 900, "\x85 x\x1c y", "é Å ﬁ", "the the"]
    df = docs(spark, [*enumerate(texts), (99, None), (0, "")])
    got = bpe.digests(df, path).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        t = texts[x.doc_id] if x.doc_id < 99 else ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(df.limit(0), path).count() == bpe.encode(df.limit(0), path).count() == 0
    full = {x.doc_id: x for x in bpe.encode(df.withColumnRenamed("source", "decoded"), path).collect()}
    assert all(list(full[i].token_ids) == library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts))
    assert bpe.codec(path).decode(full[2].token_ids) == full[2].decoded


# 9


def plain_scores(texts, held):
    train = [(i, t) for i, t in texts if not held(i)]
    words = Counter(w for _, t in train for w in ppm.words_of(t))
    total, kinds = sum(words.values()) + len(train), len(words) + bool(train)
    counts = {}
    for _, t in train:
        s = ppm.PAD + ppm.stream(ppm.words_of(t))
        for i in range(ppm.ORDER, len(s)):
            for j in range(ppm.ORDER + 1):
                counts.setdefault(s[i - j : i], Counter())[s[i]] += 1
    out = {}
    for i, t in texts:
        w = ppm.words_of(t)
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (kinds + 1))) for c in [*(words[x] for x in w), len(train)])
        out[i] = (held(i), len(w) + 1, sum(words[x] > 0 for x in w) + bool(train), total, base, sum(ppm.code_lengths(ppm.PAD + ppm.stream(w), counts)))
    return out


@pytest.mark.parametrize(("sent", "hot"), [(4_000_000, 500_000), (50, 3)])
def test_ppm_against_its_definition(spark, sent, hot):
    texts = made(4, 40)
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want = plain_scores(texts, held)
    got = ppm.score(docs(spark, texts), ppm.id_crc() % 10 != 0, sent, hot).collect()
    assert len(got) == len(want)
    for x in got:
        assert tuple(x)[1:5] == want[x.doc_id][:4]
        assert (x.base_score, x.score) == (pytest.approx(want[x.doc_id][4]), pytest.approx(want[x.doc_id][5]))


def test_ppm_repeats_empty_and_mass(spark):
    df = docs(spark, [(1, "a b"), (1, "a b"), (2, None)])
    got = ppm.score_documents(df).collect()
    assert sorted((x.doc_id, x.n_tokens) for x in got) == [(1, 3), (1, 3), (2, 1)]
    assert ppm.score_documents(df.limit(0)).count() == 0
    counts = {}
    s = ppm.PAD + b"the thing then \n"
    for i in range(ppm.ORDER, len(s)):
        for j in range(ppm.ORDER + 1):
            counts.setdefault(s[i - j : i], Counter())[s[i]] += 1
    every = [c for c in range(256) if c not in (9, 11, 12, 13)]
    assert sum(10 ** [*ppm.code_lengths(s[: ppm.ORDER + 2] + bytes([c]), counts)][-1] for c in every) == pytest.approx(1)


# 10


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site of the day</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
<div class="ad">Buy one of the best</div><aside>More of this</aside>{article}
<div id=comments><p>I think the article is of the best that I have read in a long time, and it was.</p></div>
<form><label>Mail</label></form><footer>&copy; 2024 The site</footer></body></html>"""
LONG = "It was the best of times and it was the worst of times, and the people of the town were not in a hurry to be told."


def test_html(spark):
    article = f"<article><h1>Title &amp; more</h1><p><b>{LONG}<br>Tail&nbsp;x<p>Short.</p><!-- no --><section class=comments><p>{LONG}</p></section></article>"
    plain = f"<div class=content><p>{LONG}</p><p>Short.</p></div><div><a href=a>One</a> <a href=b>Two</a></div>"
    rows = [(1, "u", PAGE.replace("{article}", article)), (2, "u", PAGE.replace("{article}", plain)), (3, "u", None), (4, "u", ""), (5, None, f"<article><p>{LONG} <unended"), (6, "u", "<html><body><nav>x</nav></body></html>")]
    got = {x.page_id: x for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == f"Title & more {LONG} Tail x Short."
    assert got[2].text == f"{LONG} Short."
    assert [got[i].text for i in (3, 4, 6)] == ["", "", ""]
    assert got[5].text.startswith(LONG)
    assert all(x.n_chars == len(x.text) for x in got.values())


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', '<div class="entry-content">{}</div>', "<div>{}</div>", "{}", "<ARTICLE>{}<div class=ad>Buy one of the best</div></ARTICLE>", "<article><p class=advert>Buy it</p>{}</article>"])
def test_html_finds_the_article_in_any_frame(frame):
    inner = f"<h1>Head line</h1><p>Short.</p><p>{LONG}</p><p>End.</p>"
    assert html.main_text(PAGE.replace("{article}", frame.format(inner))) == f"Head line Short. {LONG} End."


POLISH = "Wszystkie szczęśliwe rodziny są do siebie podobne, każda nieszczęśliwa rodzina jest nieszczęśliwa na swój sposób. W domu Obłońskich zapanował zamęt. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><p>{POLISH * 2}</p><p>{POLISH}</p></body>", f"{POLISH * 2}{POLISH}".strip()),
        ("<body><h1>Head</h1><p>It was a short one.</p></body>", "Head It was a short one."),
        ("<article><p><a href=x>Some link text here</a></p><p>Read also</p><p><a>More links</a></p></article>", ""),
        (f"<article><h2>Head</h2><p><a>By some one</a></p><p>{LONG}</p><p><a>More links</a></p><p>Read also</p><p><a>More links</a></p></article>", f"Head {LONG}"),
        (f"<article><p>Teaser.</p></article><p>{LONG}</p><p>End.</p>", f"{LONG} End."),
        (f"<article><p>{LONG}</p></article><p>Other words of it.</p>", LONG),
    ],
)
def test_html_labels_inherit_from_the_nearest(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("bad", ['<a "', "<div>", '<a x="', "<a x='\">", "<!--", '<p class="x', "<div></span>", "<title", "</p", "<article><div></main>", "<li>", "&", "<article>", "</b><div>"])
def test_html_takes_time_by_length(bad):
    import time

    start = time.perf_counter()
    html.main_text(bad * (600_000 // len(bad)) + "</b>" * 100_000)
    assert time.perf_counter() - start < 20


def test_html_edges(spark):
    rows = [(1, "u", "<p>a</p>", "x")] * 3 + [(None, None, "<p>b", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumnRenamed("text", "n_chars")
    assert sorted((x.page_id or 0, x.text) for x in html.extract(df).collect()) == [(0, "b"), (1, "a"), (1, "a"), (1, "a")]
    assert html.extract(df.limit(0)).count() == 0


# All


EXTRA = "rid gone fp key bucket h slot shard pos term own value m part packed node root words lines at size n item items score lang_pred held_out _rid _i".split()


@pytest.mark.parametrize(
    "operator",
    [
        lambda df, bench: langid.identify(df),
        lambda df, bench: shards.shard_documents(df),
        lambda df, bench: linededup.dedup_lines(df).select("doc_id", "text", "n_removed"),
        lambda df, bench: simhash.near_duplicates(df),
        lambda df, bench: simhash.first_of_each(df).select("doc_id", "text"),
        lambda df, bench: decontaminate.contamination(df, bench).drop("items"),
        lambda df, bench: decontaminate.clean(df, bench).select("doc_id", "text"),
        lambda df, bench: bpe.digests(df, FILES.path("word_bpe_49k.json")),
        lambda df, bench: bpe.encode(df, FILES.path("word_bpe_49k.json")).select("doc_id", "n_tokens"),
        lambda df, bench: ppm.score_documents(df).select("doc_id", "n_tokens", "n_known"),
        lambda df, bench: pii.pseudonyms(df, "k").select("doc_id", "text"),
    ],
)
def test_other_columns_and_a_very_long_text_change_nothing(spark, operator):
    from pyspark.sql import functions as F

    texts = [*made(6, 20), (500, "alpha beta of the " * 5_000)]
    df = docs(spark, texts)
    bench = spark.createDataFrame([(1, "alpha beta of the alpha beta of the")], "item_id long, text string")
    more = df.withColumns({c: F.lit(c) for c in EXTRA})
    plain, extra = (sorted(map(repr, operator(x, y).collect())) for x, y in ((df, bench), (more, bench.withColumns({c: F.lit(c) for c in EXTRA}))))
    assert plain == extra and len(plain) > 0
