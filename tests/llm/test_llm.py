"""The training-data operators against brute force, on odd rows: nulls, empty and long texts, repeats, clashing columns."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup, langid, mixing, ngram_join, packing, pii, quality, token_store, toxicity, warc
from tidewater.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, label string, size long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(seed, n, words=4000):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, words, n))


def odd_docs():
    base = sentence(1, 120)
    near = [" ".join([*base.split()[:i], f"new{i}", *base.split()[i + 1 :]]) for i in (3, 60, 100)]
    texts = [None, "", " \t", "one", "One", "a b c d", "A b c d", base, base.upper(), *near, sentence(2, 60), sentence(3, 30000), "x\ny", "x\t y", "é ü ñ", "naïve café's"]
    texts += [" ".join([*near[0].split()[:-2], f"t{i}", "end"]) for i in range(40)]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2", "s3"][i % 4], 0, 7, "x", 9) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (None, base, "en", "s1", 0, 7, "x", 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_docs(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, empty):
    groups = {}
    for r in odd_docs():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    out = exact_dedup.exact_dedup(docs).collect()
    want = sorted(((d, min(x for x in g if x is not None), len(g)) for g in groups.values() for d in g), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in out), key=str) == want
    assert sum(r.kept for r in out) == len(groups) == exact_dedup.keep_first(docs).count()
    own = docs.select("doc_id", "text", "lang", F.lit(1).alias("place"), F.lit("a").alias("first"))
    kept = exact_dedup.keep_first(own)
    assert kept.columns == own.columns and {r.doc_id for r in kept.collect()} == {min(x for x in g if x is not None) for g in groups.values()}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_runs_merge_in_rounds_without_sorting_what_is_sorted(spark):
    rows = [(i, f"text {i % 50}") for i in range(600)] + [(None, "text 3"), (None, "alone"), (7, "text 7")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(300)
    want = Counter(t for _, t in rows)
    for bits in (1, 4, 20):
        merged = exact_dedup.merge_runs(exact_dedup.fingerprints(df), bits)
        assert sorted(r["size"] for r in merged.collect()) == sorted(want.values())
        plan = merged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        rounds = {1: 9, 4: 3, 20: 1}[bits]
        assert plan.count(" Exchange hashpartitioning") == rounds and plan.count(" Sort ") == rounds + 1 and "Python" not in plan and "Arrow" not in plan
    # Of rows equal in identifier and text the least by the other columns stays, whatever the order.
    same = [(1, "a b", 5), (1, "a b", 4), (1, "a  b", 3), (2, "a b", 1)]
    first = [exact_dedup.keep_first(spark.createDataFrame(x, "doc_id long, text string, n int")).collect() for x in (same, same[::-1])]
    assert len(first[0]) == 1 and first[0] == first[1] and first[0][0].doc_id == 1


def brute_components(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for r in rows:
        w = WORD.findall((r[1] or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {}
    for c, r in zip(comp, rows):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted(((r[0], len(s), least.get(c)) for r, s, c in zip(rows, sets, comp)), key=str)


def test_jaccard(docs, empty):
    out = ngram_join.jaccard_components(docs).collect()
    assert sorted(map(tuple, out), key=str) == brute_components(odd_docs())
    assert ngram_join.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_of_random_variants(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    r = np.random.default_rng(seed)
    rows, bases = [], [sentence(10 + i, int(r.integers(20, 80))).split() for i in range(4)]
    passage = sentence(99, 40).split()
    for i in range(150):
        w = list(bases[r.integers(4)])
        for _ in range(r.integers(0, 4)):
            w[r.integers(len(w))] = f"e{r.integers(30)}"
        if r.random() < 0.3:
            w = w[: len(w) // 3] + passage
        rows.append((i, " ".join(w)))
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=str) == brute_components(rows)


def test_mixing(spark, docs, empty):
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    plan = {r.source: r for r in mixing.plan_mix(sized).collect()}
    total = sum(len(WORD.findall(r[1] or "")) for r in odd_docs())
    assert sum(p.target for p in plan.values()) == pytest.approx(total)
    assert all(p.target <= 3 * p.source_size for p in plan.values())
    assert [plan[s].weight for s in ("s1", "s2", "s3", None)] == [1, 2, 3, 1]
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    again = Counter(r.doc_id for r in mixing.emit(docs).collect())
    assert Counter(r.doc_id for r in out.collect()) == again and max(again.values()) <= 9
    assert mixing.emit(empty).count() == 0


def reference(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return lambda s: np.array(t.encode(s or "", add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "kept")])
def test_pieces_encode_like_the_library(name, spaces):
    from tidewater.llm.tokens import PieceEncoder

    r, own, ids = np.random.default_rng(3), PieceEncoder(vocabulary(name), spaces), reference(name)
    parts = ["a", "B", "é", " ", " ", "\n", "\t", "'s", "1", "22", ".", "%%", "\xa0", "\x1c", "\x85", "İ", "Σ", "é", "e\u0301", "中", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "\n\n", "'LL", "-", "😀"]
    parts += ["\u200b", "\u200d", "\ufeff", "\u1100", "\u1161", "\u11a8", "한", "ก", "\u0e33", "ا", "\u0651", "ल", "\u094d", "ﬁ", "\u212b", "\x00", "²", "٣", "\u3000", "½", "\u2019s", "ẞ", "ŉ"]
    for _ in range(8000):
        text = "".join(r.choice(parts, r.integers(0, 12)))
        assert own.encode([text])[0] == ids(text).tobytes(), text


def test_token_store(spark, docs, empty, tmp_path, monkeypatch):
    ids = reference("word_bpe_49k.json")
    token_store.write_store(docs, f"file://{tmp_path}/s", vocabulary("word_bpe_49k.json"), "dropped", 1)
    out = token_store.read_store(spark, f"file://{tmp_path}/s").collect()
    want = Counter((r[0], np.append(ids(r[1]), 1).astype("<u4").tobytes()) for r in odd_docs())
    assert Counter((r.doc_id, bytes(r.ids)) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    monkeypatch.setattr(token_store, "SHARD_DOCS", 3)
    manifest = token_store.write_store(docs, f"file://{tmp_path}/m", vocabulary("word_bpe_49k.json"), "dropped", 1)
    assert max(s["docs"] for s in manifest["shards"]) == 3
    assert sorted(map(tuple, token_store.read_store(spark, f"file://{tmp_path}/m").collect()), key=str) == sorted(map(tuple, out), key=str)
    some = token_store.Shard(f"file://{tmp_path}/m", manifest["shards"][1]["shard"])
    assert [some.ids_at(i) for i in range(3)] == some.ids_between(0, 3)
    token_store.write_store(empty, f"file://{tmp_path}/e", vocabulary("word_bpe_49k.json"), "dropped", 1)
    assert token_store.read_store(spark, f"file://{tmp_path}/e").count() == 0


def test_dictionary_of_a_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SAMPLE_DOCS", 400)
    rows = [(i, sentence(i, 200, 300)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, again = (token_store.train_dictionary(d, vocabulary("word_bpe_49k.json"), "dropped", "doc_id", "text") for d in (docs, docs.repartition(7)))
    assert first and first == again


def test_packing(docs, empty):
    ids = reference("byte_bpe_50k.json")
    out = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), "kept", 0, 64).collect()
    want, got, room = Counter(), Counter(), {}
    for r in odd_docs():
        x = np.append(ids(r[1]), 0).astype("<u4")
        for a in range(0, len(x), 64):
            want[r[0], a, len(x), zlib.crc32(x[a : a + 64].tobytes())] += 1
    for r in out:
        got[r.doc_id, r.start, r.doc_tokens, r.ids_crc32] += 1
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want and sorted(room) == list(range(len(room)))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(empty, vocabulary("byte_bpe_50k.json"), "kept", 0).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_shortest_pack_first(seed):
    r = np.random.default_rng(seed)
    histogram = {int(k): int(r.integers(1, 500)) for k in r.integers(1, 129, 60)}
    packs = packing.shortest_pack_first(histogram, 128)
    used = Counter()
    for pattern, n in packs:
        assert sum(a * b for a, b in pattern) <= 128
        for a, b in pattern:
            used[a] += b * n
    assert used == histogram


def test_quality(docs, empty):
    by = {r.doc_id: r for r in quality.quality(docs).collect()}
    for row in odd_docs():
        text, got = row[1] or "", by[row[0]]
        words = WORD.findall(text)
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert got.base_failed == (len(words) < 20 or 100 * len(hit) > 30 * len(words)) and not (got.kept and got.base_failed)
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns and quality.keep_good(empty).count() == 0
    assert quality.keep_good(docs).count() == sum(by[r[0]].kept for r in odd_docs())


def brute_distances(rows):
    """Class and word distance to the nearest language of each row (id, text, lang), from the definitions alone."""
    import math

    def failed(text):
        words = WORD.findall(text)
        grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        return len(words) < 20 or 100 * len(hit) > 30 * len(words)

    def kind(c):
        for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?-'", "\"()[]{}/_", "#*$%&|<>@^~+=\\`", "\n")):
            if c in chars:
                return k
        return None if c in " \t\r\x0b\x0c" else 8 if ord(c) > 127 else 7

    def js(p, q):
        p, q = ({k: v / sum(x.values()) for k, v in x.items() if v} for x in (p, q))
        if not p:
            return 0.0
        total = 0.0
        for k in {*p, *q}:
            a, b = p.get(k, 0), q.get(k, 0)
            total += sum(x * math.log2(2 * x / (a + b)) for x in (a, b) if x) / 2
        return math.sqrt(max(0.0, total))

    runs = [Counter(re.findall(r"[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, _ in rows]
    kinds = [Counter(k for c in t or "" if (k := kind(c)) is not None) for _, t, _ in rows]
    refs = []
    for lang in {r[2] for r in rows} - {None}:
        own = [i for i, r in enumerate(rows) if r[2] == lang]
        sound = [i for i in own if not failed(rows[i][1] or "")]
        if len(sound) >= quality.MIN_DOCS:
            every = sum((runs[i] for i in own), Counter())
            common = {w for w, n in every.items() if n >= quality.COMMON_SHARE * sum(every.values())}
            some = lambda c, common=common: Counter({w if w in common else None: 0 for w in c}) + Counter([x for w, n in c.items() for x in [w if w in common else None] * n])
            refs.append((some, sum((some(runs[i]) for i in sound), Counter()), sum((kinds[i] for i in sound), Counter())))
    return [(min(js(k, r[2]) for r in refs), min(js(r[0](w), r[1]) for r in refs)) for k, w in zip(kinds, runs)]


def spoken(r, words, n=150):
    return " ".join(r.choice(words.split(), n))


EN = "the the the of of and and to in river house walked slowly green window harbour lantern paper cloud stone garden light calm over"


def test_distances_are_those_of_the_definition(spark):
    r = np.random.default_rng(5)
    rows = [(i, spoken(r, EN, int(r.integers(20, 200))) + f". x{i} é!", "en") for i in range(40)]
    rows += [(100 + i, spoken(r, "река дом и и и в в пошёл медленно зелёный окно", 90), "ru") for i in range(25)]
    rows += [(200, "#$% 99 <<" * 40, None), (201, spoken(r, EN), "xx"), (202, None, "en"), (203, "The THE river", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {x.doc_id: (x.class_distance, x.word_distance) for x in quality.quality(df).collect()}
    for (i, _, _), want in zip(rows, brute_distances(rows)):
        assert got[i] == pytest.approx(want, abs=1e-9), i


def test_common_words_are_the_corpus_own_whatever_the_partitions(spark, monkeypatch):
    r = np.random.default_rng(8)
    docs = [("xx", " ".join([*r.choice("qua dor mi".split(), 5), *(f"{a}{b}" for a, b in zip(r.choice(list("bcdfgh"), 200), r.choice([f"{x}{y}" for x in "aeiou" for y in "klmnpqrst"], 200)))])) for _ in range(60)]
    runs = Counter(w for _, t in docs for w in t.split())
    common = {w for w, n in runs.items() if n >= quality.COMMON_SHARE * sum(runs.values())}
    import pyarrow as pa
    from tidewater.llm.kernels import Words

    want = {int(Words(pa.array([w])).hashes(True).view(np.int64)[0]) for w in common}
    for parts, block in ((1, 1_000_000), (7, 1_000_000), (2, 500)):
        monkeypatch.setattr(quality, "BLOCK_WORDS", block)
        found = quality.candidates(spark.createDataFrame(docs, "lang string, text string").repartition(parts))["xx"]
        assert want <= found and len(found) <= 4 / (3 * quality.COMMON_SHARE)


def test_divergence_rejects_what_is_unlike_all_languages(spark):
    r = np.random.default_rng(5)
    rows = [(i, t, "en") for i, t in enumerate([*(spoken(r, EN) for _ in range(40)), " ".join("#$%^ {}|| 9182 ==>" for _ in range(100)) + " " + " ".join(f"@{i}##" for i in range(99))])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [x.doc_id for x in quality.quality(df).collect() if not x.kept] == [40]
    assert sorted(x.doc_id for x in quality.keep_good(df).collect()) == list(range(40))


def test_words_alone_reject_a_text_without_function_words(spark):
    r = np.random.default_rng(6)
    nouns = "".join(f"{a}{b}ing " for a in "bcdfghklmn" for b in ("ar", "el", "os", "un", "it", "am", "ed", "ov", "ul", "ap", "ir", "on", "es", "at", "og", "um", "ac", "ib", "ef", "oy", "az", "ik", "ut"))
    text = lambda listed, n: " ".join(r.permutation([*r.choice("the of and to in".split(), listed), *r.choice(nouns.split(), n - listed)]))
    rows = [*((i, text(int(r.integers(40, 50)), 150), "en") for i in range(40)), (40, text(0, 150), "en"), (41, text(1, 150), "en"), (42, text(0, 50), "en")]
    schema = "doc_id long, text string, lang string"
    out = {x.doc_id: x for x in quality.quality(spark.createDataFrame(rows, schema)).collect()}
    assert [i for i, x in sorted(out.items()) if not x.kept] == [40, 41]
    assert not out[40].base_failed
    # A language without common words is not asked for them, and shields no text of another one.
    rows += [(100 + i, " ".join(f"z{x:04d}".translate(str.maketrans("0123456789", "abcdefghij")) for x in r.integers(0, 9999, 150)), "zz") for i in range(25)]
    assert sorted(x.doc_id for x in quality.quality(spark.createDataFrame(rows, schema)).collect() if not x.kept) == [40, 41]


def test_a_language_without_reference_is_held_to_the_base_rules(spark):
    r = np.random.default_rng(7)
    good = [(i, spoken(r, EN), "en") for i in range(40)]
    schema = "doc_id long, text string, lang string"
    for n in (quality.MIN_DOCS - 1, quality.MIN_DOCS):
        rows = [*good, *((100 + i, spoken(r, "река дом пошёл медленно зелёный окно пристань и в на"), "ru") for i in range(n)), (200, "дом", "ru")]
        out = {x.doc_id: x for x in quality.quality(spark.createDataFrame(rows, schema)).collect()}
        assert [i for i, x in sorted(out.items()) if not x.kept] == [200]
        assert (out[100].class_distance > 0.3) == (n < quality.MIN_DOCS)


def test_every_language_with_enough_documents_is_a_reference(spark):
    text = sentence(9, 40).translate(str.maketrans("0123456789", "abcdefghij"))
    rows = [(i, text, f"l{i % 510:03d}") for i in range(510 * quality.MIN_DOCS)]
    _, refs = quality.measured_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), "doc_id", "text", "lang")
    assert len(refs) == 510 and len(refs[0].places) == len(set(text.split()))


def test_toxicity(spark, docs, empty):
    r = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(200):
        bad = i % 4 == 0
        words = [*r.choice("calm river stone garden light paper cloud".split(), 15), *(["hateful"] if bad else [])]
        rows.append((i, " ".join(r.permutation(words))))
        labels.append((i, int(bad)))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert all(x.predicted == (x.doc_id % 4 == 0) for x in out)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)
    assert toxicity.score(docs, model).where("score between 0 and 1").count() == len(odd_docs())
    weights, bias, scale = dict(zip(model[0].tolist(), model[1])), model[3], dict(zip(model[0].tolist(), model[2]))
    for i, text in [(r[0], r[1]) for r in rows[:20]] + [(None, "hateful"), (None, " \t hateful\n\nriver  É"), (None, "")]:
        # By hand: the distinct n-grams of the text between single spaces, scaled to length 1.
        raw = b" " + re.sub(rb"[\x20\x09-\x0D]+", b" ", text.lower().encode()).strip(b" ") + b" " if text.strip() else b"  "
        grams = {raw[j : j + n] for n in toxicity.SIZES for j in range(len(raw) - n + 1)}
        h = lambda g: int(toxicity.gram_buckets(g)) if len(g) else 0
        found = {h(g) for g in grams} & set(weights)
        size = sum(scale[g] ** 2 for g in found) ** 0.5
        z = bias + sum(weights[g] * scale[g] / size for g in found)
        got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().score if i is None else next(x.score for x in out if x.doc_id == i)
        assert got == pytest.approx(1 / (1 + np.exp(-z)))
    nothing = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, nothing).where("predicted = 0").count() == len(odd_docs())


def test_language(spark, docs, empty):
    r = np.random.default_rng(2)
    stock = {"en": "the house and water with stone".split(), "fr": "été maison où eau très pierre".split(), "de": "straße häuser und wasser über stein".split()}
    rows = [(i, " ".join(r.choice(stock[k], 20)), k) for i, k in enumerate(r.choice(list(stock), 150))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    out = {x.doc_id: x for x in langid.identify(df, model).collect()}
    assert np.mean([out[i].lang_pred == k for i, _, k in rows]) > 0.98
    odd = langid.identify(docs, model).collect()
    assert len(odd) == len(odd_docs()) and {x.lang_pred for x in odd if x.doc_id in (0, 1, 2)} == {"und"}
    assert langid.identify(docs, langid.train(empty)).where("lang_pred = 'und'").count() == len(odd_docs())
    # By hand: the margins of a text's byte pairs and triples, and the nearest codeword by weighted logistic loss.
    for i in (0, 1, 2):
        raw = re.sub(rb"[\x20\x09-\x0D]", b" ", rows[i][1].encode().lower())
        share = np.zeros(langid.BUCKETS)
        for j in range(len(raw) - 2):
            two = raw[j] << 8 | raw[j + 1]
            share[(two * 2654435761 % 2**32) >> 20] += 1
            share[((two << 8 | raw[j + 2]) * 2246822519 % 2**32) >> 20] += 1
        margin = share / (2 * len(raw)) @ model["w"] + model["bias"]
        loss = [(np.log1p(np.exp(-margin * c)) * model["reliable"]).sum() for c in model["codes"]]
        share = np.exp(min(loss) - np.array(loss))
        assert out[i].lang_pred == model["langs"][int(np.argmin(loss))] and out[i].score == pytest.approx(share.max() / share.sum(), rel=1e-4)
    # A text half of one and half of another language is flagged, a clear one not, and a rare language is learned.
    half = " ".join([*r.choice(stock["en"], 10), *r.choice(stock["fr"], 10)])
    got = langid.identify(spark.createDataFrame([(1, half), (2, " ".join(r.choice(stock["en"], 20)))], "doc_id long, text string"), model).collect()
    assert got[1].ambiguous is False and got[1].score > got[0].score
    unclear = langid.decode(np.zeros((1, model["codes"].shape[1])), model)
    assert unclear[2][0]
    rare = [*rows, *((10_000 + i, "ruka kniha voda strom dům", "cs") for i in range(3))]
    assert "cs" in langid.train(spark.createDataFrame(rare, "doc_id long, text string, lang string"))["langs"]
    codes = langid.codewords(40)
    assert min((codes[i] != codes[j]).sum() for i in range(40) for j in range(i)) >= 5


def test_personal_data(spark, docs, empty):
    texts = ["mail bob.x@ex-a.org, a@b@c.de or x@y", "ip 10.0.0.1 and 300.1.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +44 20 7946 0958 or +1 (2)", None, "", "x" * 5000 + "@" + "1" * 6000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find_spans(df, pii.train(df)).collect():
        t = texts[r.doc_id] or ""
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        digits = lambda s: re.sub("[^0-9]", "", s)
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        assert [tuple(s) for s in r.base] == want
    assert pii.find_spans(docs, pii.train(docs)).count() == len(odd_docs())
    assert pii.redact("a b@c.de d", [("email", 2, 8)]) == "a [email] d"
    assert pii.find_spans(docs, None).count() == len(odd_docs()) and pii.train(empty) is None
    x = np.array([[float(i % 7), float(i % 3)] for i in range(300)])
    y = (x[:, 0] > 3).astype(float)
    assert ((pii.Trees(x, y).predict(x) > 0.5) == y).all()


def plain_texts(n, seed=4):
    r = np.random.default_rng(seed)
    return [" ".join(r.choice("the river house of walked slowly, 12 green to 1999 window Harbour and lantern".split(), 80)) for _ in range(n)]


def test_trees_find_forms_that_the_base_patterns_miss():
    texts = plain_texts(250)
    pool = {"email": ["bob.x@mail.example.com"], "ip": ["10.1.22.3"], "card": ["4111 1111 1111 1111"], "phone": ["+1 (202) 555-0172"]}
    model = pii.fit([t + " " + " ".join(x[0] for x in pool.values()) for t in texts])
    new = [pii.planted(t, np.random.default_rng((77, i)), pool) for i, t in enumerate(plain_texts(150, 5))]
    base = [pii.base_spans(t) for t, _, _ in new]
    found = pii.added_spans([t for t, _, _ in new], base, model)
    right = sum(len(set(f) & set(good)) for f, (_, good, _) in zip(found, new))
    assert right >= 0.9 * sum(len(good) for _, good, _ in new) and right >= 0.95 * sum(map(len, found))
    for spans, own in zip(found, base):
        marks = Counter(i for _, a, b in spans for i in range(a, b))
        assert not marks or max(marks.values()) == 1
        assert not any(i in marks for _, a, b in own for i in range(a, b))
    assert pii.added_spans(plain_texts(50, 6), [[]] * 50, model) == [[]] * 50
    # Judged one by one, texts get the same spans as judged together.
    assert [pii.added_spans([t], [b], model)[0] for (t, _, _), b in zip(new[:20], base)] == found[:20]


def test_a_text_with_many_spans_takes_linear_time():
    from time import process_time

    model = pii.fit(plain_texts(60))
    took = []
    for n in (4000, 16000):
        text = " ".join(f"ann{i}@host.org bob{i} (at) host.org" for i in range(n))
        start = process_time()
        base = pii.base_spans(text)
        pii.added_spans([text], [base], model)
        took.append(process_time() - start)
        assert len(base) == n
    assert took[1] < 10 * took[0]


def test_an_address_part_is_read_whole():
    for n in (1, 400, 401, 3998, 5000):
        assert pii.base_spans("9" + "0" * (n + 2) + ".1.1.1") == []
        assert pii.base_spans("0" * n + "255.1.0.1") == [("ip", 0, n + 9)]


def test_warc(spark, tmp_path):
    long = "<p>" + sentence(8, 30000) + "</p>"
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, None), (3, "http://b/", ""), (4, "http://c/", long), (5, "http://d/\r\nx", long), (6, "http://e/", "é" * 9000), (7, "http://f/", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    names = warc.write_archives(warc.decided(pages), f"file://{tmp_path}/w", segment=4096)
    out = {r.page_id: r for r in warc.read_archives(spark, f"file://{tmp_path}/w", names).collect()}
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    for i, _, html in rows:
        payload, last = (html or "").encode(), max(groups[html or ""])
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(payload), warc.digest(payload))
        assert (out[i].record_type, out[i].refers_to) == (("response", None) if i == last else ("revisit", last))
        assert i != last or bytes(out[i].payload) == payload
    odd = spark.createDataFrame([(1, "u", "x", 5, "w", b"p", "s"), (None, None, "x", 6, "w", b"p", "s")], "page_id long, url string, html string, size int, winner string, payload binary, sha string")
    names = warc.write_archives(warc.decided(odd), f"file://{tmp_path}/o")
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_archives(spark, f"file://{tmp_path}/o", names).collect()) == [("1", "response", None), ("None", "revisit", 1)]
    names = warc.write_archives(warc.decided(odd.limit(0)), f"file://{tmp_path}/n")
    assert names == [] and warc.read_archives(spark, f"file://{tmp_path}/n", names).count() == 0
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_warc_keeps_rows_that_share_a_page_id(spark, tmp_path):
    big = ["<p>" + sentence(i, 3000) + "</p>" for i in range(20, 26)]
    rows = [(1, big[0]), (1, big[0]), (2, big[1]), (2, big[2]), (None, big[3]), (None, big[4]), (None, big[4]), (None, big[0]), (3, "x"), (3, "x"), (None, "y"), (9, big[5]), (8, big[5])]
    pages = spark.createDataFrame([(i, "http://a/", t) for i, t in rows], "page_id long, url string, html string").repartition(3)
    names = warc.write_archives(warc.decided(pages), f"file://{tmp_path}/w", segment=4096)
    out = warc.read_archives(spark, f"file://{tmp_path}/w", names).collect()
    assert Counter((r.page_id, r.payload_digest) for r in out) == Counter((i, warc.digest(t.encode())) for i, t in rows)
    revisits = [(r.page_id, r.refers_to, r.payload_digest) for r in out if r.record_type == "revisit"]
    assert Counter(revisits) == Counter([(None, 1, warc.digest(big[0].encode())), (8, 9, warc.digest(big[5].encode()))])
    assert all(warc.digest(bytes(r.payload)) == r.payload_digest for r in out if r.record_type == "response")
    # A revisit names the record that holds its payload.
    heads = [h for n in names for h, _ in warc.read_records(open(f"{tmp_path}/w/{n}", "rb"))]
    held = {h["warc-record-id"] for h in heads if h["warc-type"] == "response"}
    assert all(h["warc-refers-to"] in held for h in heads if h["warc-type"] == "revisit")


def test_jaccard_compares_rows_without_identifier_and_rows_that_share_one(spark):
    base, other = sentence(31, 60).split(), sentence(32, 60).split()
    near = lambda w, i: " ".join([*w[:i], f"new{i}", *w[i + 1 :]])
    rows = [(5, " ".join(base)), (None, near(base, 20)), (None, near(other, 3)), (None, near(other, 40)), (7, near(base, 50)), (7, near(other, 50)), (7, near(other, 50)), (8, ""), (None, None), (8, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place long").repartition(3)
    got = ngram_join.jaccard_components(df).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
    # Of each component one row stays, rows without words all stay.
    kept = [r.place for r in ngram_join.keep_one(df).collect()]
    assert sorted(kept)[0] == 0 and len(kept) == 1 + 3 + 3 and sum(k in (5, 6) for k in kept) == 1


@pytest.mark.parametrize("parts", [7, 5000])
def test_exchange_counts_tokens_with_any_number_of_parts(spark, parts, monkeypatch):
    monkeypatch.setattr(ngram_join, "LOCAL", 3)
    rows = [(i, " ".join(["the same ten words are in all of these texts", sentence(500 + i, 30), sentence(900 + i // 4, 40)])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    want = Counter(t for _, text in rows for t in {tuple(w[j : j + 5]) for w in [text.split()] for j in range(len(w) - 4)})
    for r in ngram_join.token_counts(df, parts, 1.0).collect():
        w = rows[r.id][1].split()
        own = [c for c in (want[t] for t in {tuple(w[j : j + 5]) for j in range(len(w) - 4)}) if c > 1]
        counts = np.frombuffer(r.counts, np.int32)
        assert counts.tolist() == sorted(own) and r.n == len(w) - 4 and len(r.tokens) == 2 * len(r.counts)


def test_documents_of_shared_paragraphs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", 20)
    monkeypatch.setattr(ngram_join, "PAIRS_A_ROW", 1)
    r = np.random.default_rng(3)
    stock = [sentence(200 + i, 12) for i in range(14)]
    rows = [(i, " ".join(stock[j] for j in r.choice(14, 5, replace=False))) for i in range(500)]
    rows += [(1000 + i, " ".join([sentence(300, 7), f"end{i}"])) for i in range(60)]
    rows += [(2000 + i, f"{sentence(400, 300)} {stock[i % 14]} x{i}") for i in range(60)]
    calls, own = [], ngram_join.divided
    monkeypatch.setattr(ngram_join, "divided", lambda *tables: calls.append(1) or own(*tables))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows) and calls


def joined_rows(spark, before):
    """Output rows of each inner join that has run since execution ``before``."""
    store = spark._jsparkSession.sharedState().statusStore()
    out, runs = [], store.executionsList()
    for i in range(runs.size()):
        number = runs.apply(i).executionId()
        if number <= before:
            continue
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if re.search("Join", node.name()) and "Inner" in node.desc():
                metrics = [node.metrics().apply(j) for j in range(node.metrics().size())]
                out += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return out


def test_members_of_a_near_threshold_group_do_not_meet_at_sizes_out_of_reach(spark):
    r = np.random.default_rng(5)
    base, rows = sentence(600, 300).split(), []
    for i in range(300):
        w = list(base)
        for at in r.choice(len(w), r.integers(4, 13), replace=False):
            w[at] = f"e{i}-{at}"
        rows.append((i, " ".join([*w, *(f"z{i}-{j}" for j in range(r.integers(0, 8)))])))
    store = spark._jsparkSession.sharedState().statusStore()
    before = max((store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())), default=-1)
    entries, own = [], ngram_join._Links.meet
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ngram_join._Links, "meet", lambda self, members, *how: entries.append(members.count()) or own(self, members, *how))
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows) and 50 < len({x.component_id for x in got}) < 280
    assert max(joined_rows(spark, before)) <= 3 * max(entries)


def test_intermediate_tables_go(spark, docs, tmp_path, monkeypatch):
    from tidewater.plans import scratch

    monkeypatch.setattr(scratch, "scratch_root", lambda spark: f"file://{tmp_path}")
    left = lambda: sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    out = ngram_join.jaccard_components(docs)
    assert left() == ["components", "keys"] and out.count() == len(odd_docs())
    out = quality.quality(docs)
    assert left() == ["components", "distances", "keys"] and out.count() == len(odd_docs())
