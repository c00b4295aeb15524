"""Training-data operators against brute force, on small documents with nulls, copies, ties and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from braidcheck.llm import chat, decontaminate, fingerprints, idfiles, language, maxent, neardup, packing, substrings, tokens, urls
from braidcheck.llm.common import shared_dir, written

pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


def texts(seed=5, n=90):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(r.choice([3, 30, 90, 200]))) for _ in range(12)]
    out = [None, "", " \n ", "one two", "one TWO", "a" * 3000, "ab " * 700]
    while len(out) < n:
        t = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 3, 9])):
            t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t) + r.choice(["", ".", "\n", " x"]))
    return out


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    rows = [(i * 3, t, ["en", "fr"][i % 2], "s", len(t or ""), f"clash {i}") for i, t in enumerate(texts())]
    path = tmp_path_factory.mktemp("docs")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_shingles string").repartition(3)
    df.write.parquet(f"{path}/documents.parquet")
    return str(path), {i: t for i, t, *_ in rows}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_tables(spark, empty):
    from braidcheck.llm.queries import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, empty).count() == 0, name


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(items):
    parent = {i: i for i in items}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(items)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = items[a], items[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {i: top(i) for i in items}


def test_near_duplicates(spark, documents):
    path, docs = documents
    want = components({i: sets_of(t) for i, t in docs.items()})
    got = {r["doc_id"]: r for r in neardup.op4_minhash_near_dedup(spark, path).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets_of(t)), want[i], want[i] == i) for i, t in docs.items()}


def test_near_duplicates_in_blocks(spark, documents, monkeypatch):
    """Buckets that are split into many chunks give the same."""
    path, docs = documents
    monkeypatch.setattr(neardup, "CHUNK", 2)
    want = components({i: sets_of(t) for i, t in docs.items()})
    assert {r["doc_id"]: r["component_id"] for r in neardup.op4_minhash_near_dedup(spark, path).collect()} == want


def repeats(docs, length=400):
    count = Counter()
    for t in docs.values():
        b = (t or "").encode()
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for i, t in docs.items():
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        runs = sum(1 for k in range(len(cover)) if cover[k] and (not k or not cover[k - 1]))
        out[i] = (len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_substrings(spark, documents, monkeypatch, hot):
    path, docs = documents
    monkeypatch.setattr(substrings, "HOT_CLASSES", hot)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.op8_suffix_array_dedup(spark, path).collect()}
    assert got == repeats(docs)


def test_packing(spark, documents):
    path, docs = documents
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    rows = packing.pack(spark.read.parquet(f"{path}/documents.parquet"), capacity=64).collect()
    want = {}
    for i, text in docs.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 64):
            want[i, k // 64] = (k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= 1 + math.ceil(sum(x[1] for x in want.values()) / 64 * 1.05)


def test_packing_plan_is_no_worse_than_best_fit():
    import bisect

    for seed in range(60):
        r = random.Random(seed)
        capacity = r.choice([10, 50, 4096])
        sizes = [min(capacity - 1, max(1, int(r.lognormvariate(3, 1.5)))) for _ in range(r.choice([1, 5, 500]))]
        plan = packing.Plan(dict(Counter(sizes)), capacity)
        used = Counter()
        for contents, times in plan.groups:
            assert sum(a * b for a, b in contents) <= capacity
            for length, each in contents:
                used[length] += each * times
        rooms: list[int] = []
        for s in sorted(sizes, reverse=True):
            at = bisect.bisect_left(rooms, s)
            bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - s)
        assert used == Counter(sizes) and plan.sequences <= len(rooms)


ODD = ["a  b", "  a b ", " a\n b\t c  ", "\x1c a \x1d b", "x 's  it's'll", "é́ ́a  b", "<|endoftext|> x", "", "　 a b", "a \u0085 b", "ΑΣ ΣΑ Σ", "a,b, c. d.. e., f ,g .h !. _.x ,\n.y", ". a", "it's.5,6 \n", "x\x1f y", "~ a ~b c~"]


@pytest.mark.parametrize("name, stretches", [("word_bpe_49k.json", tokens.blank_separated), ("byte_bpe_50k.json", tokens.blank_led)])
def test_cached_encoding(name, stretches):
    e = tokens.CachedEncoder(public.path(name), stretches)
    some = ODD + [t for t in texts(9, 60) if t]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in e.tokenizer.encode_batch(some, add_special_tokens=False)]
    assert e(some) == want and e(some[::-1]) == want[::-1]


def test_id_files_round_trip(spark, documents):
    path, docs = documents
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    start, want = 0, {}
    for i in sorted(docs):
        ids = np.array([*t.encode(docs[i] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in idfiles.op10_token_id_files(spark, path).collect()} == want


def test_id_blocks():
    r = np.random.default_rng(0)
    for k in range(40):
        ids = r.integers(0, [2, 200, 50257, 2**32][k % 4], int(r.integers(0, 3000)), dtype=np.uint32)
        blocks = idfiles.pack_blocks(ids)
        starts = np.cumsum([0, *map(len, blocks)]).tolist()[:-1]
        assert (idfiles.unpack_blocks(b"".join(blocks), starts) == ids).all()


def test_fingerprints(spark, documents):
    path, docs = documents
    rows = {r["doc_id"]: r for r in fingerprints.op1_document_fingerprints(spark, path).collect()}
    ids = sorted(docs, reverse=True)
    by_text = {}
    for k, i in enumerate(ids):
        text, after = docs[i] or "", docs[ids[(k + 1) % len(ids)]] or ""
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        assert rows[i]["n_chars"] == n and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
        assert by_text.setdefault(text, rows[i]["fingerprint"]) == rows[i]["fingerprint"]


def test_fingerprint_estimates(spark):
    from pyspark.sql import functions as F

    a = " ".join(f"w{i}" for i in range(4000))
    b = " ".join(f"w{i}" for i in range(1000))
    f = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b"))
    r = f.select(fingerprints.containment(f.b, f.a).alias("c"), fingerprints.resemblance(f.a, f.b).alias("j"), fingerprints.merge(f.a, f.b).alias("m"), "a").first()
    assert r["c"] == 1.0 and abs(r["j"] - 0.25) < 0.05 and r["m"] == r["a"]


def test_language(spark, documents):
    r = random.Random(2)
    en, fr = ["the", "and", "with", "house", "water", "which"], ["le", "être", "maison", "eau", "quelque", "nous"]
    rows = [(i, " ".join(r.choice([en, fr][i % 2]) for _ in range(40)), ["en", "fr"][i % 2]) for i in range(80)] + [(90, None, "en"), (91, "123 !", None), (92, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in language.identify(docs, language.fit(docs.where("doc_id % 4 <> 2"))).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in rows[:80])
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] for i in (90, 91, 92))


def test_language_model(spark, documents):
    path, docs = documents
    rows = maxent.op3_lm_scoring(spark, path).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in docs.items()}
    count = Counter(w for i in docs if not held[i] for w in words[i])
    total, distinct = sum(count.values()), len(count)
    for r in rows:
        w = words[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(w), sum(x in count for x in w), total)
        assert abs(r["base_score"] - sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w)) < 1e-6
        assert r["score"] < 0
    assert len(rows) == len(docs)


def test_language_model_sums_to_one(spark, documents):
    """Over all seen words and one unseen word of each class, after any history."""
    path, docs = documents
    model, counts = maxent.fit(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"), shared_dir(spark))
    seen = {}
    for t in docs.values():
        w, b = maxent.tokens(t)
        for x, k in zip(w.tolist(), b.tolist()):
            seen[x] = k
    n = {r["word"] % 2**64: r["n"] for r in counts.collect()}
    rows = maxent.rows_of(maxent.history_hashes(*maxent.tokens("some words before this")), len(model.table))
    p = maxent.probabilities(model.weights, model.bias, rows)[-1]
    total = sum(p[model.class_of[k]] * n[x] * 10 ** model.seen[model.class_of[k]] for x, k in seen.items())
    has = {int(model.class_of[k]) for k in seen.values()}
    total += sum(p[c] * 10 ** model.unseen[c] for c in range(maxent.CLASSES) if c in has) + sum(p[c] for c in range(maxent.CLASSES) if c not in has)
    assert abs(total - 1) < 1e-3


def test_leaks(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    items = [(k, " ".join(r.choice(words) for _ in range(20)) + ". " + " ".join(r.choice(words) for _ in range(8)) + ".") for k in range(30)]
    noise = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs, want = [(100, None), (101, "")], set()
    for i in range(60):
        if i % 3:
            docs.append((i, noise(150)))
        else:
            k = r.randrange(30)
            docs.append((i, f"{noise(r.randint(0, 90))} {items[k][1].upper() if i % 2 else items[k][1]}\n{noise(r.randint(0, 90))}"))
            want.add((i, k))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([*items, (77, None), (78, "")], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(d, b).collect()} == want


def test_wand_against_all_sums():
    r = random.Random(8)
    items = [(k, " ".join(str(r.randrange(40)) for _ in range(r.randint(1, 12)))) for k in range(50)]
    index = decontaminate.Index.of(items)
    for _ in range(200):
        terms = sorted({index.vocabulary[w] for w in (str(r.randrange(40)).encode() for _ in range(15)) if w in index.vocabulary})
        sums = defaultdict(float)
        for t in terms:
            for i, w in zip(*index.postings[t]):
                sums[int(i)] += w
        got = dict(decontaminate.wand(index, terms, set(range(20)), 0.4))
        assert set(got) == {i for i, s in sums.items() if s >= 0.4 - 1e-9} and all(abs(got[i] - sums[i]) < 1e-9 for i in got)


def test_urls(spark):
    rows = [(0, None), (1, "no scheme"), (2, "http://A.Example.COM/en/1"), (3, "https://www.example.com/en/x?y#z"), (4, "http://x.net/fr/1"), (5, "http://net"), (6, "ftp://x.net?q"), (7, "http://xexample.com/en/"), (8, "http://b.org/en/5"), (8, "http://b.org/en/5"), (9, "http://É.net/es/a")]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    want = {0: ("", "", None), 1: ("", "", None), 2: ("a.example.com", "/en/1", "example.com/en/"), 3: ("www.example.com", "/en/x", "www.example.com/en/"), 4: ("x.net", "/fr/1", "net/fr/"), 5: ("net", "", None), 6: ("x.net", "", None), 7: ("xexample.com", "/en/", "com/"), 8: ("b.org", "/en/5", None), 9: ("É.net", "/es/a", "net/es/")}
    assert {i: (r["host"], r["path"], r["rule"]) for i, r in got.items()} == want
    assert got[2]["verdict"] == "block" and got[3]["verdict"] == "allow" and all(r["verdict"] in ("allow", "block") for r in got.values())


def test_url_templates(spark):
    rows = [(f"h{k % 3}.com", f"/shop/{k}/view", "block") for k in range(60)] + [(f"h{k % 3}.com", f"/blog/post-{k}", "allow") for k in range(60)]
    found = urls.templates(spark.createDataFrame(rows, "host string, path string, label string"), shared_dir(spark)).select("host", "template", "block_share").distinct().collect()
    share = {(r["host"], r["template"]): r["block_share"] for r in found}
    assert share[("h0.com", "/shop/*/view")] > 0.8 and all(s < 0.3 for (h, t), s in share.items() if t.startswith("/blog"))


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'q "1"'), (1, 2, "assistant", "a"), (1, 3, "assistant", "b"), (1, 600, "user", None), (1, 700, "assistant", "c"), (2, 0, "assistant", "early"), (2, 1, None, None), (None, 1, "user", "x"), (3, 0, "user", "open")]
    got = {(r["conv_id"], r["turn"]): r for r in chat.chat_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows)
    assert got[1, 1]["json"] == '{"arguments":{"prompt":"q \\"1\\"","turn":1},"id":"1-1","name":"reply","role":"user"}' and got[1, 1]["link_turn"] == 2 and got[1, 1]["valid"]
    assert got[1, 2]["valid"] and not got[1, 3]["valid"] and got[1, 3]["link_turn"] == 1
    assert not got[1, 600]["valid"] and got[1, 600]["link_turn"] == 700 and got[1, 700]["call_id"] == "1-600"
    assert not got[2, 0]["valid"] and got[2, 0]["call_id"] is None and got[3, 0]["link_turn"] is None


def test_argument_faults(spark):
    from pyspark.sql import functions as F

    rows = [("reply", '{"turn": 1, "prompt": "x"}'), ("reply", '{"turn": "1"}'), ("reply", "[1]"), ("reply", "{"), ("other", "{}"), (None, None)]
    df = spark.createDataFrame(rows, "name string, args string")
    got = [r["f"] for r in df.select(chat.argument_faults(F.col("name"), F.col("args")).alias("f")).collect()]
    assert got == [[], ["missing prompt", "turn is not integer"], ["arguments are no object"], ["arguments are no object"], ["unknown function"], ["unknown function"]]
    assert df.select(chat.canonical(F.lit('{ "b": [1, 2], "a": {"d":1, "c":null} }'))).first()[0] == '{"a":{"c":null,"d":1},"b":[1,2]}'


def test_topological_levels(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("f", "g"), ("g", "f"), ("x", "a")], "before string, after string")
    assert {r["id"]: r["level"] for r in chat.topological_levels(nodes, edges, shared_dir(spark)).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 1, "f": None, "g": None}


def test_pipeline_stages(spark, documents, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    path, docs = documents
    spark.createDataFrame([(1, texts()[20])], "item_id long, text string").write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    now = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        now = written(stage(spark, now, path), shared_dir(spark), name)
        assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "near_dedup":
            kept = {r["doc_id"]: r["text"] for r in now.collect()}
            left = components({i: sets_of(t) for i, t in kept.items()})
            assert all(i == c for i, c in left.items())
    assert {r["doc_id"] for r in pipeline.STAGES[-1][1](spark, now, path).collect()} == {r["doc_id"] for r in now.collect()}


def test_pipeline_cuts_passages_of_over_50_words(spark):
    """Passages of 51 words under 400 bytes, in several groups, and long strings without blanks; those of 50 words stay."""
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(3)
    unique = iter(range(10**6))
    fresh = lambda n: " ".join(f"u{next(unique)}" for _ in range(n))
    passage = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5))) for _ in range(n))
    long, short, tight = [passage(n) for n in (51, 64, 51)], passage(50), "".join(r.choice("abcdefgh") for _ in range(500))
    assert all(len(x) < 400 for x in long)
    docs, want = [], {}
    for i in range(12):
        for k, held in enumerate([*long, short, tight]):
            a, b = fresh(r.randint(0, 70)), fresh(r.randint(1, 70))
            docs.append((i * 10 + k, f"{a} {held.replace(' ', chr(10)) if i % 2 else held} {b}", "en", "s", 0))
            want[i * 10 + k] = f"{a} {held.replace(' ', chr(10)) if i % 2 else held} {b}" if held is short else f"{a}  {b}"
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in pipeline.cut_repeated_passages(spark, d, "").collect()}
    # The bytes next to a string without blanks go too where occurrences share them.
    assert {i: t.split() for i, t in got.items() if i % 10 < 4} == {i: t.split() for i, t in want.items() if i % 10 < 4}
    assert len(got) == len(docs) and not any(tight[:9] in t for t in got.values())


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_word_runs(spark, documents, monkeypatch, hot):
    path, docs = documents
    monkeypatch.setattr(substrings, "HOT_CLASSES", hot)
    count = Counter()
    words = {i: (t or "").encode().split() for i, t in docs.items()}
    for w in words.values():
        count.update(tuple(w[k : k + 51]) for k in range(len(w) - 50))
    want = {}
    for i, w in words.items():
        for k in range(len(w) - 50):
            if count[tuple(w[k : k + 51])] > 1:
                want.setdefault(i, set()).update(range(k, k + 51))
    rows = substrings.repeated_spans(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text"), shared_dir(spark), substrings.WORDS).collect()
    assert {r["doc_id"]: {p for x in r["spans"] for p in range(x["b"], x["e"])} for r in rows} == want


def test_far_texts_of_each_length_are_rejected(spark):
    """Where all labelled texts are long, too; and near texts of each length are not."""
    r = random.Random(6)
    vocabulary = [["the", "and", "with", "house", "water", "which", "other", "never"], ["le", "être", "maison", "eau", "quelque", "nous", "jamais", "autre"]]
    prose = lambda i, n: " ".join(r.choice(vocabulary[i % 2]) for _ in range(n))
    rows = [(i, prose(i, 300), ["en", "fr"][i % 2]) for i in range(160)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert (model.radius > 0).all()
    for n in (10, 40, 100, 250, 2000):
        for alphabet in ("qxzjkvwyjq", "бгджзйклмн"):
            far = [" ".join("".join(r.choice(alphabet) for _ in range(r.randint(3, 8))) for _ in range(n)) for _ in range(10)]
            assert all(x[2] for x in model.predict(far)), n
        assert not any(x[2] for x in model.predict([prose(i, n) for i in range(20)])), n


def test_chat_levels(spark):
    """Levels follow from the dependency graph: a call after another's result, and calls that wait for each other."""
    rows = [(1, 0, "user", "a", None), (1, 1, "assistant", "b", None), (1, 2, "user", "c", ["1-0"]), (1, 3, "assistant", "d", None), (1, 4, "assistant", "e", None), (1, 5, "user", "f", ["1-2", "1-0", None])]
    rows += [(2, 0, "user", "a", ["2-2"]), (2, 1, "assistant", "b", None), (2, 2, "user", "c", ["2-0"]), (2, 3, "assistant", "d", None), (2, 4, "user", "e", ["2-2"]), (2, 5, "user", "f", ["9-9"])]
    rows += [(3, 0, "assistant", "early", None), (3, 1, "system", "s", None), (None, 0, "user", "x", None)]
    got = chat.chat_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depends_on array<string>")).collect()
    want = {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 3, (1, 4): 3, (1, 5): 4, (2, 0): None, (2, 1): None, (2, 2): None, (2, 3): None, (2, 4): None, (2, 5): 0, (3, 0): 1, (3, 1): 0, (None, 0): 0}
    assert len(got) == len(rows) and {(r["conv_id"], r["turn"]): r["level"] for r in got} == want


def test_words_of_one_class_are_told_apart_by_history(spark):
    """Two words of one ending and one count: the one that follows a word always is likelier there; and slots' probabilities add up to 1."""
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["left xxqaaa", "right yyqaaa"]) for _ in range(40))) for i in range(200)] + [(900, "left xxqaaa"), (901, "left yyqaaa"), (902, "right xxqaaa"), (903, "right yyqaaa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = maxent.fit(docs.where("doc_id < 900"), shared_dir(spark))
    w, b = maxent.tokens("left xxqaaa yyqaaa")
    assert b[1] == b[2] and model.class_of[b[1]] == model.class_of[b[2]]
    assert np.allclose(model.share[model.share.sum(axis=1) > 0].sum(axis=1), 1)
    s = {x["doc_id"]: x["score"] for x in maxent.score(docs, model, counts).collect()}
    assert s[900] > s[901] + 0.3 and s[903] > s[902] + 0.3
    assert maxent.MOST_FEATURES >= maxent.table_rows(5_000_000_000) > maxent.table_rows(1_000_000_000) > maxent.table_rows(1000) == maxent.FEATURES


def test_language_sample_is_held_compactly(spark):
    """The driver holds the vectors of one language at a time, and counts as bytes."""
    import tracemalloc

    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(300)), f"l{i % 4}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache()
    docs.count()
    language.letter_table()
    tracemalloc.start()
    model = language.fit(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.languages == ["l0", "l1", "l2", "l3"] and model.centroids.shape == (16, language.DIMENSIONS)
    assert most < 150e6, most


def test_packed_numbers_sort_as_lists_do():
    r = random.Random(9)
    rows = [[r.choice([0, 1, 255, 256, 65_536, 70_000]) for _ in range(r.randint(0, 4))] for _ in range(300)]
    packed = [language._packed(np.array(x, dtype=np.int64)) for x in rows]
    assert [language._unpacked(x).tolist() for x in sorted(packed)] == sorted(rows)


def test_a_round_of_components_is_one_pass(spark, tmp_path):
    """Neither star plans what is below it twice, so a round has few tasks."""
    from braidcheck.llm.components import large_star, small_star

    r = random.Random(10)
    edges = spark.createDataFrame([(r.randrange(300), r.randrange(300)) for _ in range(250)], "u long, v long")
    for star, most in ((large_star, 1), (small_star, 1)):
        plan = star(edges)._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" not in plan and sum("Join " in x for x in plan.splitlines()) <= most, plan
