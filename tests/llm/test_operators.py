"""The ten operators against plain versions, on odd rows: nulls, empty and long texts, ties, repeats, no rows, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sedge.llm import bpe, common, components, digest, huffman, langid, lines, mixing, neardup, pii, repeats, suffixes, toxicity
from sedge.llm.common import shared_dir
from sedge.llm.entries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, _block string, _doc string, lost int, score string, rep int"


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghilmnoprstu", k=r.randint(2, 7))) for _ in range(max(3, n // 3))]
    out = [r.choice(words) for _ in range(n)]
    for i in range(0, n, 9):
        out[i] = out[i].capitalize()
    return " ".join(w + (".\n" if i % 23 == 22 else "." if i % 11 == 10 else "") for i, w in enumerate(out))


def odd_rows() -> list[tuple]:
    base = prose(150, 1)
    near = base.replace(base.split()[70], "zzz", 1)
    texts = [base, base, near, None, "", "   \n\t ", "x", "Été à Noël, naïve œuvre! 日本語 😀", prose(20_000, 2), "a" * 5000, "<|endoftext|> Hi<|startoftext|>", prose(150, 3) + base[:300], prose(60, 4), "one two", "One TWO", "9 " * 40, "\x00\x1c odd  ctl"]
    rows = [(10 * i, t, "en" if i % 3 else None, "hot" if i % 2 else (None if i == 4 else "b"), 7) for i, t in enumerate(texts)]
    rows += [rows[0], rows[3], (None, base, "en", "b", 1), (None, None, None, None, None)]
    return [(*r, "x", "y", "z", 1, "s", 2) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenizer_path())


def texts_of(docs) -> list[tuple]:
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def same(a, b) -> None:
    key = lambda x: tuple((v is not None, str(v)) for v in x)
    assert sorted(map(tuple, a), key=key) == sorted(b, key=key)


def test_bpe_is_the_library(spark, docs, none, tok):
    got = bpe.encoded(docs.select("doc_id", "text", "source"), tokenizer_path()).select("doc_id", "ids", "decoded").collect()
    want = []
    for d, t in texts_of(docs):
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((d, ids, tok.decode(ids, skip_special_tokens=False)))
    same(got, want)
    assert bpe.encoded(none, tokenizer_path()).count() == 0


def test_bpe_on_random_text(tok):
    r, b = random.Random(5), bpe.loaded(tokenizer_path())
    parts = ["a", "e", "th", "ing", "'s", "'", "1", " ", "\n", "é", "é", "ß", "中", "!", ".", ",", "—.", "×,", "<|endoftext|>", "\xa0", "İ", "Σ", "😀", "Q"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(1500)]
    flat, offsets = b.chunks.ids(pa.array(texts))
    for i, t in enumerate(texts):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert flat[offsets[i] : offsets[i + 1]].tolist() == ids == b.encode(t)
        assert b.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_token_files_round_trip(spark, docs, none, tok):
    for df in (docs, none):
        folder = shared_dir(spark, "test")
        huffman.token_files(df, tokenizer_path(), 1, folder)
        got = huffman.crc_of_ids(huffman.read_token_files(spark, folder)).collect()
        rows = []
        for d, t in texts_of(df):
            ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
            rows.append((d, ids))
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes()))
        at, want = 0, []
        for d, ids in rows:
            want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        same(got, want)


def test_huffman_codes():
    r = np.random.default_rng(0)
    for m, limit in ((1, 4), (2, 1), (5, 3), (300, 9), (1000, 18)):
        counts = np.maximum(1, (1e6 / (1 + np.arange(m)) ** 2).astype(np.int64))
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and (0.5**lengths).sum() <= 1
        ids = np.sort(r.choice(60_000, m, replace=False))
        code = huffman.Code(ids, lengths)
        blocks = [ids[r.integers(0, m, n)] for n in (0, 1, 511, 512, 513, 5000)]
        made = [code.encode(b) for b in blocks]
        back = code.decode([x[0] for x in made], [x[1] for x in made], np.array([len(b) for b in blocks]))
        assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, np.int64), 2)


def test_digests(spark, docs, none):
    got = digest.fingerprints(docs).collect()
    rows = sorted(texts_of(docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = []
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()))
    same([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (0, 10)}) == 1
    assert digest.fingerprints(none).count() == 0


def test_digest_likeness():
    texts = [prose(600, s) for s in range(8)]
    half = [digest.edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    rank = digest.ranks(digest.histogram(pa.array(texts)))
    a, b = digest.digests(pa.array(texts), rank), digest.digests(pa.array(half), rank)
    for i in range(7):
        assert digest.likeness(a[i], a[i]) == 1
        assert digest.likeness(a[i], b[i]) == digest.likeness(b[i], a[i]) > 0.25 > digest.likeness(a[i], a[i + 1])


def test_digest_likeness_across_lengths():
    """Texts of 640 bytes and more, and shorter ones that share much with them."""
    texts = [prose(400, s)[:986] for s in range(12)]
    parts = [digest.edited(t, "so many words") for t in texts]
    copies = [t[:620] for t in texts]
    assert all(len(x) < 640 for x in parts + copies)
    rank = digest.ranks(digest.histogram(pa.array(texts)))
    a, b, c = (digest.digests(pa.array(x), rank) for x in (texts, parts, copies))
    for i in range(12):
        assert digest.likeness(a[i], b[i]) == digest.likeness(b[i], a[i]) > 0.25 > digest.likeness(a[i], b[i - 1])
        assert digest.likeness(a[i], c[i]) > 0.5
        assert digest.likeness(b[i], c[i]) > 0.25 > digest.likeness(b[i], c[i - 1])


def test_line_quality(spark, docs, none):
    got = {(r["doc_id"], r["n_words"]): r for r in lines.line_quality(docs).collect()}
    for d, t in texts_of(docs):
        w = WORDS.findall(t)
        seen: dict[tuple, list[int]] = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {p for places in seen.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
        own = [x for x in t.split("\n") if WORDS.search(x)]
        r = got[d, len(w)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert lines.line_quality(docs).count() == docs.count() and lines.line_quality(none).count() == 0


def test_frequent_lines_reject(spark):
    boiler = "Sign in to read more of this page today and tomorrow and every other day of the week that follows soon."
    rows = [(i, f"{boiler}\nUnique {i}.", "h") for i in range(40)] + [(100 + i, prose(60, i), "h") for i in range(40)] + [(200, boiler + "\nfew", "other")]
    rows += [(300 + i, prose(60, 99), "h") for i in range(50)]  # exact copies count once
    out = {r["doc_id"]: r["kept"] for r in lines.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(out[i] for i in range(40)) and all(out[100 + i] for i in range(40)) and out[200] and all(out[300 + i] for i in range(50))


def test_frequent_lines_are_removed(spark, docs, none):
    boiler = "Sign IN to read  1 more"
    rows = [(i, f"{boiler.replace('1', str(i % 10))}\n\nown {'x' * (i + 1)}\nlast", "h") for i in range(12)] + [(50, boiler, "h"), (51, None, "h"), (52, boiler + "\nx", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in lines.without_frequent_lines(df).collect()}
    assert out == {i: f"\nown {'x' * (i + 1)}" for i in range(12)} | {50: "", 51: None, 52: boiler + "\nx"}
    quality = {r["doc_id"]: r for r in lines.line_quality(df).collect()}
    assert all(r["text"] == out[d] and r["n_left_chars"] == len(out[d] or "") for d, r in quality.items()) and quality[3]["n_lost_words"] == 7 and quality[52]["n_lost_words"] == 0
    assert lines.without_frequent_lines(docs).count() == docs.count() and lines.without_frequent_lines(docs).columns == [c for c in docs.columns if c not in ("_doc", "lost")]
    assert lines.without_frequent_lines(none).count() == 0


def test_unknown_languages_are_rejected(spark):
    r = random.Random(3)
    made = {x: ["".join(r.choices(letters, k=r.randint(2, 8))) for _ in range(200)] for x, letters in (("a", "aeiouklmn"), ("b", "aeiourstd"), ("c", "bcdfghjpqvwxz"))}
    text = lambda x, n: " ".join(r.choices(made[x], k=n))
    rows = [(i, text(x, 40 + 5 * (i % 20)), x) for i, x in enumerate("ab" * 60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(i, text(x, 80), x) for i, x in enumerate("abc" * 20)] + [(99, text("c", 5), "short")], "doc_id long, text string, lang string")
    out = langid.predicted(test, model).collect()
    assert all(x["rejected"] == (x["lang"] == "c") for x in out) and all(x["lang_pred"] == x["lang"] for x in out if x["lang"] in "ab")


def test_language(spark, docs, none):
    en, fr = "the house and the garden with many other things that were there", "la maison et le jardin avec beaucoup des autres choses qui sont là"
    rows = [(i, (en if i % 2 else fr) + " " + str(i), "en" if i % 2 else "fr") for i in range(60)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = langid.predicted(docs, model).select("doc_id", "text", "lang_pred", "score").collect()
    for r in out:
        assert r["lang_pred"] == "und" if not any(c.isalpha() for c in r["text"] or "") else r["lang_pred"] in ("en", "fr")
        assert 0 <= r["score"] <= 1
    test = spark.createDataFrame([(1, "the other things and the many"), (2, "le jardin et la maison des choses")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predicted(test, model).orderBy("doc_id").collect()] == ["en", "fr"]
    assert {r["lang_pred"] for r in langid.predicted(docs, langid.train(none)).collect()} == {"und"}
    assert langid.predicted(none, model).count() == 0


def test_pii_base_is_the_contract():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("a.@-+12 3(4)b_%é55..@@") for _ in range(r.randint(0, 40)))
        assert [m.span() for m in email.finditer(t)] == list(pii.emails(t))
        assert [m.span() for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))] == list(pii.ips(t))
    assert list(pii.ips("9" * 100_000)) == [] and list(pii.emails("a" * 100_000)) == []


def test_pii_kinds():
    t = "Card 4111 1111 1111 1111, not 4111 1111 1111 1112. IBAN DE89 3704 0044 0532 0130 00 Bank. Call +1 (389) 555-5010 or ssn 123-45-6789."
    kinds = [s["kind"] for s in pii.find(t)]
    assert kinds == ["card", "phone", "iban", "ssn"]
    assert pii.redacted(t, pii.find(t)) == "Card [CARD], not 4111 1111 1111 1112. IBAN [IBAN] Bank. Call [PHONE] or ssn [SSN]."
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.find("part 123-45-6789") == [] and pii.redacted("abc", []) == "abc"


def test_pii_rows(spark, docs, none):
    assert pii.redact(docs).count() == docs.count() and pii.redact(none).count() == 0
    assert pii.redact(docs).where(F.col("text").isNull()).count() == docs.where("text is null").count()


def test_toxicity(spark, docs, none):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        t = prose(r.randint(20, 80), i)
        if toxic:
            t += " You are a " + r.choice(["vileword", "nastyterm"]) + " indeed. " + prose(20, 1000 + i)
        rows.append((i, t))
        labels += [(i, int(toxic))] * (1 + i % 2)
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    out = {x["doc_id"]: x for x in toxicity.scored(df, toxicity.train(df, lab)).collect()}
    test = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i]["predicted"] == (i % 4 == 0) for i in test]) > 0.97
    hit = next(i for i in test if i % 4 == 0 and out[i]["predicted"])
    start, end = out[hit]["offending"][0][:2]
    assert "word" in rows[hit][1].encode()[start:end].decode() or "term" in rows[hit][1].encode()[start:end].decode()
    model = toxicity.train(none, lab)
    assert {x["score"] for x in toxicity.scored(docs, model).collect() if x["doc_id"] in (30, 40)} <= {0.0}
    assert toxicity.scored(none, model).count() == 0 and toxicity.scored(docs, model).count() == docs.count()


def plain_components(rows: list[tuple], words: int, percent: int) -> dict:
    sets = {}
    for d, t in rows:
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in t))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    ids = sorted(sets)
    change = True
    while change:
        change = False
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                n = len(sets[a] & sets[b])
                if label[a] != label[b] and n and 100 * n >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    change = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def test_near_duplicates(spark, docs, none):
    known = docs.where("doc_id is not null")
    got = neardup.near_duplicates(docs, words=3, similarity=0.85).collect()
    assert len(got) == docs.count()
    want = plain_components(list(dict(texts_of(known)).items()), 3, 85)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicate_star(spark, monkeypatch):
    """Copies that are near their source, but not each other, hold together though their regions are parted."""
    monkeypatch.setattr(neardup, "REGION", 16)
    r = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        w = list(base)
        for k in r.sample(range(200), 4):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, prose(100, i)) for i in range(50)]
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, similarity=0.85).collect()}
    want = plain_components(rows, 3, 85)
    assert got == {d: c for d, (_, c) in want.items()}


def templated(n: int, words: int, low: float, high: float) -> list[tuple]:
    """A family of n pairs: different pairs are about low alike, the two of a pair about high, just above or below the limit."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(400)]

    def changed(w: list, k: int, name: str) -> list:
        w = list(w)
        for i in r.sample(range(0, len(w) - words, words), k):
            w[i + words // 2] = f"{name}_{i}"
        return w

    # k words apart cost words x k shingles on each side
    apart = lambda j: round(400 * (1 - j) / (1 + j) / words)
    rows = []
    for i in range(n):
        one = changed(base, round(apart(low) / 2), f"x{i}")
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(changed(one, apart(high) + i % 2, f"y{i}")))]
    return rows


def test_near_duplicates_in_a_family_below_the_limit(spark, monkeypatch):
    """Isolated true pairs among many documents nearly as alike: regions are parted, yet each pair is found."""
    monkeypatch.setattr(neardup, "REGION", 8)
    monkeypatch.setattr(neardup, "BLOCK", 16, raising=False)
    rows = templated(150, 3, 0.8, 0.86)
    want = plain_components(rows, 3, 85)
    assert 50 < sum(c != d for d, (_, c) in want.items()) and max(Counter(c for _, c in want.values()).values()) == 2
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, similarity=0.85).collect()}
    assert got == {d: c for d, (_, c) in want.items()}


def test_near_duplicates_in_a_large_family(spark):
    """Parameters as shipped: 1,000 pairs over one template, all different pairs below the limit, compared with all pairs by matrix product."""
    rows = templated(1000, 3, 0.78, 0.87)
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    names = {g: i for i, g in enumerate(g for g, n in Counter(g for s in sets for g in s).items() if n > 1)}
    m = np.zeros((len(rows), len(names)), np.float32)
    for i, s in enumerate(sets):
        m[i, [names[g] for g in s if g in names]] = 1
    size, both = np.array([len(s) for s in sets]), m @ m.T
    a, b = np.nonzero(np.triu(100 * both >= 85 * (size[:, None] + size[None] - both), 1))
    links = spark.createDataFrame([(rows[i][0], rows[j][0]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], "a long, b long")
    want = {d: d for d, _ in rows} | {x["node"]: x["component"] for x in components.components(links).collect()}
    assert len(a) >= 1000
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), words=3, similarity=0.85).collect()}
    assert got == want


def test_texts_of_one_id_are_one_node(spark):
    x, y = prose(120, 31), prose(120, 32)
    rows = [(1, x), (1, y), (2, x + " zz"), (3, y + " zz"), (4, prose(120, 33))]
    for order in (rows, rows[::-1]):
        got = neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), words=3, similarity=0.85).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_texts_without_a_partner_arent_shuffled(spark):
    """What goes through shuffles is less than the texts, of which few have a partner; no link is lost by that."""
    rows = [(i, " ".join(f"{random.Random(i).getrandbits(40):x}{k}" for k in range(400))) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 600, 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    stages = lambda: {x.stageId(): x.shuffleWriteBytes() for x in (lambda a: [a.apply(i) for i in range(a.size())])(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before, name = stages(), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")
    try:
        got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df, words=3, similarity=0.85).collect()}
    finally:
        spark.conf.unset(name)
    assert got == {d: d - 1000 if d >= 1000 else d for d, _ in rows}
    moved = sum(n for k, n in stages().items() if k not in before)
    assert 0 < moved < sum(len(t) for _, t in rows) / 4


def test_narrowed_keeps_all_partners(spark, monkeypatch):
    few = spark.range(0, 3000, 3)
    rows = spark.range(3000).withColumn("x", F.col("id") % 7).unionByName(spark.createDataFrame([(None, 1), (6, 9)], "id long, x long"))
    for words in (neardup.WORDS, 1):
        monkeypatch.setattr(neardup, "WORDS", words)
        got = neardup.narrowed(rows, few, "id")
        assert got.columns == rows.columns and got.where("id % 3 = 0").count() == 1001
        assert got.count() < 1200 if words > 1 else got.count() <= 3002
    assert neardup.narrowed(rows, few.where("false"), "id").count() == 0


def test_pipeline_keeps_one_of_each_pair_in_a_family(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REGION", 8)
    rows = templated(150, 5, 0.75, 0.82)
    want = {c for _, c in plain_components(rows, 5, 80).values()}
    assert len(want) < 250
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x["doc_id"] for x in corpus_pipeline.deduplicated(spark, docs, "").collect()} == want


def test_components(spark):
    r = random.Random(8)
    for n, m in ((30, 20), (200, 150), (40, 39)):
        links = [(r.randrange(n), r.randrange(n)) for _ in range(m)] if m != 39 else [(i, i + 1) for i in range(39)]
        label = list(range(n))
        for _ in range(n):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame([*links, (1, None)], "a long, b long")).collect()}
        assert got == {i: label[i] for i in {x for a, b in links if a != b for x in (a, b)}}


def test_components_end_when_links_are_stars(spark, monkeypatch):
    """No further round is written to see that nothing changes."""
    written, save = [], components.Scratch.save
    monkeypatch.setattr(components.Scratch, "save", lambda self, df: written.append(0) or save(self, df))
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame([(1, 2), (3, 1), (7, 5)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5} and len(written) == 1
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_links(spark, monkeypatch):
    """Beyond what is broadcast."""
    monkeypatch.setattr(common, "LIGHT", 0)
    test_components(spark)


def test_near_duplicates_beyond_what_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "LIGHT", 0)
    test_near_duplicates_in_a_family_below_the_limit(spark, monkeypatch)


def test_suffix_array():
    r = random.Random(2)
    for _ in range(800):
        x = np.array([r.randint(1, 3) for _ in range(r.randint(0, 40))], np.int64)
        assert suffixes.suffix_array(x, 4).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def plain_repeats(rows: list[tuple], length: int = 100) -> list[tuple]:
    """rows in order; one result each."""
    seen, out = set(), []
    for d, t in rows:
        b = t.encode()
        mark = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                mark[s : s + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        out.append((d, len(b), len(b) - len(kept), sum(1 for x in bytes(mark).split(b"\0") if x), kept))
    return out


def test_repeats(spark, docs, none):
    got = repeats.without_repeats(docs).collect()
    rows = sorted(dict.fromkeys(texts_of(docs)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    results = {(r[0], i[1]): r for r, i in zip(plain_repeats(rows), rows, strict=True)}
    same(got, [results[k] for k in texts_of(docs)])
    assert repeats.without_repeats(none).count() == 0


def test_hot_anchors_are_spread(spark, monkeypatch):
    """With every anchor hot, the result is the same."""
    shared = prose(80, 50)
    rows = [(i, prose(30, 60 + i) + shared[: 200 + i] + prose(10, 90 + i) + "ab" * (i * 20)) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_repeats(rows)
    same(repeats.without_repeats(df).collect(), want)
    every = np.unique(np.concatenate([repeats.runs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[3] for _, t in rows]))
    monkeypatch.setattr(repeats, "hot_anchors", lambda docs: every)
    same(repeats.without_repeats(df).collect(), want)


def test_mixing(spark, docs, none):
    out = mixing.mixed_documents(docs).select("doc_id", "source", "_pass", "_tokens", "_position").collect()
    ids = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in out} == ids and all(0 <= r["_position"] <= 1 for r in out)
    assert mixing.mixed_documents(none).count() == 0


def test_mixing_budgets(spark):
    tokens = {"big": 900_000, "mid": 90_000, "small": 10_000, "none": 0}
    mix = mixing.Mix(target_entropy=0.9, max_repeats=3.0)
    plan = mixing.budgets(tokens, mix)
    assert set(plan) == {"big", "mid", "small"} and abs(sum(w for w, _ in plan.values()) - 1) < 1e-9
    assert max(b / tokens[k] for k, (_, b) in plan.items()) <= 3.0001 and min(b / tokens[k] for k, (_, b) in plan.items()) > 0.9999
    flat = mixing.exponent([900, 90, 10], mixing.Mix(target_entropy=0.8, max_repeats=1e9))
    assert abs(mixing.entropy(mixing.weights([900, 90, 10], flat)) - 0.8 * np.log(3)) < 1e-6
    rows = [(i, "w " * 50, "big" if i < 900 else "small") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed_documents(df, mixing.Mix(max_repeats=2.5, block_tokens=500))
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["big"] == 900 and 225 <= n["small"] <= 250
    given = mixing.mixed_documents(df, mixing.Mix(budget=20_000, block_tokens=500)).agg(F.sum("_tokens")).first()[0]
    assert 19_800 <= given <= 20_000


def test_pipeline_stages_on_odd_rows(spark, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"
    rows = [(1, None, "en", "a", None, 0.1, "x"), (2, "", None, None, 0, None, None), (None, "call me at a.b@example.org now please", "en", "a", 5, 0.2, "y"), (4, "12 34 \u2014", "en", "a", 7, 0.3, "z")]
    df = spark.createDataFrame(rows, schema)
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, df, data).collect()] == [None]
    clean = corpus_pipeline.private(spark, df, data)
    assert clean.columns == list(corpus_pipeline.COLUMNS)
    got = {r["doc_id"]: r for r in clean.collect()}
    assert len(got) == 4 and got[1]["text"] is None and got[1]["n_chars"] is None and got[2]["n_chars"] == 0 and got[4]["text"] == "12 34 \u2014"
    assert "a.b@example.org" not in got[None]["text"] and got[None]["n_chars"] == len(got[None]["text"])
    ids = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.encoded(spark, df, data).collect()}
    assert ids[1] == ids[2] == 0 and ids[4] > 0
    for stage in (corpus_pipeline.language, corpus_pipeline.private):
        assert stage(spark, df.limit(0), data).count() == 0
