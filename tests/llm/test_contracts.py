"""Cases that every operator must bear: nulls in any column, repeated rows, very long texts, ties, other columns; and methods against exact ones."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from braidcheck.llm import chat, decontaminate, fingerprints, idfiles, language, maxent, neardup, packing, queries, substrings, tokens
from braidcheck.llm.common import shared_dir

pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

LONG = 3 << 20


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents of all odd kinds: null ids (one of them twice), repeated rows, nulls in other columns, a text of 3 MiB, clashing columns."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 8)))
    vocabulary = [word() for _ in range(20_000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = prose(90)
    long = prose(LONG // 5)[: LONG - 700] + " " + shared
    rows = [(1, long, "en"), (2, f"{prose(40)} {shared} {prose(30)}", "en"), (3, None, None), (4, "", "en"), (5, prose(60), None), (None, f"{prose(20)} {shared}", "en"), (None, prose(30), "en"), (7, prose(3), "fr")]
    rows += [rows[4], rows[6], (2**62 + 1, shared, "en"), (-5, prose(12), "en")]
    path = tmp_path_factory.mktemp("odd")
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string, word long, spans string, piece string, kept string, id string"
    spark.createDataFrame([(*x, None, None, "a", "b", 3, "c", "d", "e", "f") for x in rows], schema).repartition(2).write.parquet(f"{path}/documents.parquet")
    items = [(1, shared, "x"), (1, shared, "x"), (2, None, "x"), (None, prose(40), "x")]
    spark.createDataFrame(items, "item_id long, text string, doc_id string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(1, "http://a.com/b/c", "x"), (1, "http://a.com/b/c", "x"), (None, "http://a.net/fr/1", "x"), (2, None, None), (3, "http://a.com/" + "/".join("abcdefghij"), "x"), (4, "http://a.com/" + "/".join("abcdefghik"), "x")]
    spark.createDataFrame([(*x, "h") for x in pages], "page_id long, url string, html string, host string").write.parquet(f"{path}/pages.parquet")
    talks = [(1, 0, "user", "q", "z"), (1, 0, "user", "q", "z"), (1, 1, "assistant", "a", "z"), (None, None, None, None, None)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string, level string").write.parquet(f"{path}/conversations.parquet")
    return str(path), rows


def key(doc_id):
    return (doc_id is not None, doc_id)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.split("_")[0] in ("op1", "op2", "op3", "op4", "op8", "op10")])
def test_a_row_for_each_row(spark, odd, name):
    path, rows = odd
    got = queries.QUERIES[name](spark, path).select("doc_id").collect()
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((x[0] for x in rows), key=key)


def test_other_tables(spark, odd):
    path, rows = odd
    got = [r["page_id"] for r in queries.QUERIES["op7_url_filters"](spark, path).collect()]
    assert sorted(got, key=key) == [None, 1, 1, 2, 3, 4]
    talks = chat.op9_chat_formatting(spark, path).collect()
    assert len(talks) == 4 and sum(r["valid"] and r["role"] == "user" for r in talks) == 2


def brute_repeats(texts, length=400):
    count, out = Counter(), []
    for b in texts:
        if len(b) < 1 << 20:
            count.update(b[k : k + length] for k in range(len(b) - length + 1))
    for b in texts:
        cover = bytearray(len(b))
        whole = b"\0".join(x for x in texts if x is not b)
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if count[s] > 1 or s in whole:
                cover[k : k + length] = b"\1" * length
        out.append((len(b), sum(cover), hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest()))
    return out


def test_repeats_of_odd_documents(spark, odd):
    """The text of 3 MiB shares its end with others; copies of a row, with an id or without, lose all strings of 400 bytes."""
    path, rows = odd
    texts = [(x[1] or "").encode() for x in rows]
    small = [t for t in texts if len(t) < 1 << 20]
    tail = next(t for t in texts if len(t) > 1 << 20)[-2000:]
    want = Counter(brute_repeats([*small, tail])[:-1])
    got = queries.QUERIES["op8_suffix_array_dedup"](spark, path).collect()
    assert Counter((r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got if r["n_bytes"] < 1 << 20) == want
    assert [r["n_removed"] for r in got if r["n_bytes"] > 1 << 20] == [brute_repeats([*small, tail])[-1][1]]


def test_near_copies_of_odd_documents(spark, odd):
    path, rows = odd
    got = neardup.op4_minhash_near_dedup(spark, path).collect()
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    sizes = Counter()
    for i, t, *_ in rows:
        w = (t or "").split()
        sizes[i, len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0] += 1
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes


def test_ids_and_pieces_of_odd_documents(spark, odd):
    from tokenizers import Tokenizer

    path, rows = odd
    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, text, *_ in sorted(rows, key=lambda x: (key(x[0]), x[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r)[:4] for r in idfiles.op10_token_id_files(spark, path).collect()]
    assert sorted(got, key=lambda x: x[1]) == want
    pieces = packing.op6_best_fit_packing(spark, path).collect()
    assert sum(r["doc_id"] is None for r in pieces) == 3
    places = defaultdict(list)
    for r in pieces:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in some) <= 4096 and sorted(some)[-1][0] + sorted(some)[-1][1] == sum(n for _, n in some) for some in places.values())


def test_scores_of_odd_documents(spark, odd):
    """Repeated rows come back with one score each; no row is merged with another."""
    path, rows = odd
    got = defaultdict(list)
    for r in maxent.op3_lm_scoring(spark, path).collect():
        got[r["doc_id"]].append((r["n_tokens"], round(r["score"], 6)))
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(len((t or "").split()) + 1)
    assert {i: sorted(n for n, _ in x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert len(got[5]) == 2 and got[5][0] == got[5][1]


def test_model_does_not_depend_on_tasks(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["red", "green", "blue", "round", "cube", "of", "the"]) + r.choice("ab") for _ in range(60))) for i in range(300)], "doc_id long, text string")
    scores, first = [], None
    for n in (1, 4, 16):
        some = docs.repartition(n)
        model, counts = maxent.fit(some, shared_dir(spark))
        scores.append({x["doc_id"]: x["score"] for x in maxent.score(some, model, counts).collect()})
    assert all(abs(s[i] - scores[0][i]) < 1e-6 for s in scores for i in s)


def test_leaks_do_not_depend_on_turns(spark, monkeypatch):
    """Equal rows in one turn and in many, and the same as from all pairs of items and passages by their definition."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5))) for _ in range(120)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, f"{prose(r.randint(8, 24))}. {prose(r.randint(2, 9))}.") for k in range(40)]
    docs = []
    for i in range(90):
        held = " ".join(w if r.random() > 0.04 * (i % 4) else r.choice(words) for w in items[i % 40][1].split())
        docs.append((i, f"{prose(r.randint(0, 70))} {held if i % 3 else ''} {prose(r.randint(0, 70))}"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = []
    for at_once in (20_000, 5, 1):
        monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", at_once)
        found.append(sorted((*x[:3], *(round(y, 9) for y in x[3:])) for x in map(tuple, decontaminate.leaks(d, b).collect())))
    assert found[0] == found[1] == found[2]

    index = decontaminate.Index.of(items)
    step, want = index.longest, {}
    for i, text in docs:
        all_words = decontaminate.words_of(text)
        for start in range(0, max(1, len(all_words) - step) if len(all_words) > step else 1, step):
            passage = all_words[start : start + 2 * step]
            sums = defaultdict(float)
            for w in set(passage):
                if w in index.vocabulary:
                    for item, weight in zip(*index.postings[index.vocabulary[w]]):
                        sums[int(item)] += weight
            for item, score in sums.items():
                question, answer = (decontaminate.overlap(x, passage) for x in index.texts[item])
                if score >= decontaminate.THRESHOLD and question >= decontaminate.OVERLAP and answer >= decontaminate.OVERLAP:
                    want[i, index.ids[item]] = max(want.get((i, index.ids[item]), 0), score)
    assert {(x[0], x[1]): pytest.approx(x[3]) for x in found[0]} == want and len(want) > 30


def fewest(items, capacity):
    @functools.lru_cache(None)
    def go(left):
        if not left:
            return 0, 0
        best = (99, 0)
        for i in range(len(items)):
            if left >> i & 1:
                n, fill = go(left ^ 1 << i)
                best = min(best, (n, fill + items[i]) if n and fill + items[i] <= capacity else (n + 1, items[i]))
        return best

    return go((1 << len(items)) - 1)[0]


def test_reduction_fixes_dominating_sets_only():
    assert packing.Plan({11: 1, 10: 1, 7: 1, 3: 4}, 20).sequences == 2
    for seed in range(200):
        r = random.Random(seed)
        capacity = r.choice([10, 20, 30, 100])
        items = [r.randint(1 if r.random() < 0.5 else capacity // 4, capacity - 1) for _ in range(r.randint(1, 10))]
        plan = packing.Plan(dict(Counter(items)), capacity)
        rest = Counter(items)
        for contents, times in plan.groups[: plan.fixed_groups]:
            for length, each in contents:
                rest[length] -= each * times
        assert plan.fixed + fewest(list(rest.elements()), capacity) == fewest(items, capacity) <= plan.sequences


def test_likeness_against_whole_sets(spark, tmp_path):
    """Errors of a sketch of a quarter: the mean under 0.06, and 0 for equal texts and for texts that share nothing."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    docs = {i: " ".join(r.choice(words) for _ in range(r.choice([1, 4, 8, 40, 300, 1500]))) for i in range(80)}
    docs.update({100: docs[1], 101: docs[1], 102: " ", 103: ""})
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = sorted(docs, reverse=True)
    errors = []

    def jaccard(a, b):
        x, y = ({tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t.split() else set() for t in (a, b))
        return len(x & y) / len(x | y) if x | y else 1.0

    got = {x["doc_id"]: x for x in fingerprints.op1_document_fingerprints(spark, str(tmp_path)).collect()}
    for k, i in enumerate(ids):
        after = docs[ids[(k + 1) % len(ids)]]
        n = len(docs[i])
        edited = docs[i][: n - n // 3] + after[: n // 3]
        for name, other in (("near_edited", edited), ("near_next", after)):
            exact = jaccard(docs[i], other)
            errors.append(abs(got[i][name] - exact))
            assert exact not in (0, 1) or got[i][name] == exact
        assert got[i]["fingerprint"] or not docs[i].split()
    assert sum(errors) / len(errors) < 0.06


def test_next_document_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 3)
    monkeypatch.setattr(fingerprints, "LEAST_RANGES", 2)
    monkeypatch.setattr(fingerprints, "MOST_CUTS", 4)
    ids = sorted(random.Random(1).sample(range(-50, 1000), 60))
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["next"]["text"] for r in fingerprints.with_next(df, "doc_id", ["text"]).collect()}
    assert got == {i: f"t{ids[k - 1]}" for k, i in enumerate(ids)}


def test_chat_columns(spark):
    """Given identifiers and arguments: a broken argument, a call id used twice, a result ahead of its call, and a cycle."""
    schemas = {"add": {"a": ("integer", True)}}
    rows = [
        (1, 0, "user", "x", "c1", "add", '{ "a": 1 }', None), (1, 1, "assistant", "1", "c1", None, None, None),
        (1, 2, "user", "x", "c2", "add", '{"a": ', None), (1, 3, "assistant", "2", "c2", None, None, None),
        (1, 4, "user", "x", "c1", "add", '{"a": "1"}', ["c2"]), (1, 5, "assistant", "9", "c3", None, None, None),
        (1, 6, "user", "x", "c3", "add", '{"a": 2}', ["c4"]), (1, 7, "user", "x", "c4", "sub", '{"a": 2}', ["c3"]),
        (1, 8, "assistant", "3", "c4", None, None, None), (2, 0, "assistant", "other", "c1", None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, name string, arguments string, depends_on array<string>")
    got = {(r["conv_id"], r["turn"]): r for r in chat.chat_records(df, schemas).collect()}
    assert {k: r["valid"] for k, r in got.items()} == {(1, 0): True, (1, 1): True, (1, 2): False, (1, 3): True, (1, 4): False, (1, 5): False, (1, 6): True, (1, 7): False, (1, 8): True, (2, 0): False}
    assert got[1, 0]["link_turn"] == 1 and got[1, 4]["link_turn"] is None and got[1, 5]["link_turn"] == 6 and got[1, 6]["link_turn"] is None
    assert got[1, 6]["level"] is None and got[1, 7]["level"] is None and got[1, 3]["level"] == 1 and got[1, 0]["level"] == 2
    assert got[1, 0]["json"] == '{"arguments":{"a":1},"id":"c1","name":"add","role":"user"}' and got[1, 2]["json"].startswith('{"arguments":"{\\"a\\": ",')


def test_foreign_texts_are_rejected_by_the_query(spark, tmp_path):
    r = random.Random(4)
    vocabulary = [["the", "and", "with", "house", "water", "which", "other", "never"], ["le", "être", "maison", "eau", "quelque", "nous", "jamais", "autre"]]
    rows = [(i, " ".join(r.choice(vocabulary[i % 2]) for _ in range(80)), ["en", "fr"][i % 2]) for i in range(200)]
    rows += [(1000 + i, " ".join("".join(r.choice("бгджзклмнпрст") for _ in range(6)) for _ in range(80)), None) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in language.op2_language_id(spark, str(tmp_path)).collect()}
    assert all(got[i]["rejected"] == (i >= 1000) for i in got)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert language.op2_language_id(spark, str(tmp_path)).columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]


def test_a_file_is_read_by_blocks(tmp_path):
    ids = np.random.default_rng(2).integers(0, 50257, 9000, dtype=np.uint32)
    with open(tmp_path / "x", "wb") as f:
        writer = idfiles.Writer(f)
        writer.append([7, 8], [ids[:5000].astype("<u4").tobytes(), ids[5000:].astype("<u4").tobytes()])
        writer.close()
    with open(tmp_path / "x", "rb") as f:
        reader = idfiles.Reader(f)
        assert (reader.ids(4000, 6001) == ids[4000:6001]).all()
        assert [(d, s, (x == ids[s : s + len(x)]).all()) for d, s, x in reader.documents()] == [(7, 0, True), (8, 5000, True)]
    with pytest.raises(ValueError):
        idfiles.Reader(b"short")


def test_whole_texts_where_stretches_do_not_stand_alone(monkeypatch):
    """A tokenizer for which the trial on fixed texts fails encodes whole texts."""
    monkeypatch.setattr(tokens, "blank_led", tokens.blank_led)
    e = tokens.CachedEncoder(public.path("byte_bpe_50k.json"), tokens.blank_separated)  # the wrong way to part for this one
    assert not e.apart
    some = ["a b, c.", " x  y\n", None]
    assert e(some) == [np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in some]


def test_pipeline_stages_against_their_definitions(spark, tmp_path):
    """What language ID, decontamination and the cutting of passages keep, document by document, null ids included."""
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(8)
    vocabulary = [["the", "and", "with", "house", "water", "which", "other", "never"], ["le", "être", "maison", "eau", "quelque", "nous", "jamais", "autre"]]
    fresh = iter(range(10**6))
    prose = lambda i, n: " ".join(r.choice(vocabulary[i % 2]) + (str(next(fresh)) if k % 7 == 3 else "") for k in range(n))
    item = "which of the houses by the water never had a door that other people could open. the ninth one."
    rows = [(i, prose(i, 120), ["en", "fr"][i % 2], "s", 0) for i in range(160)]
    rows += [(None, prose(0, 120), "en", "s", 0), (None, "12 34 !", "en", "s", 0), (500, None, "en", "s", 0), (501, f"{prose(0, 30)} {item} {prose(0, 30)}", "en", "s", 0), (None, f"{prose(0, 30)} {item}", "en", "s", 0)]
    docs = spark.createDataFrame(rows, pipeline.DOCUMENTS)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = lambda df: Counter((x["doc_id"], x["text"]) for x in df.collect())
    all_ = Counter((i, t) for i, t, *_ in rows)
    assert text(pipeline.keep_identified(spark, docs, "")) == Counter({k: n for k, n in all_.items() if k[1] and k[1] != "12 34 !"})
    assert text(pipeline.drop_leaks(spark, docs, str(tmp_path))) == Counter({k: n for k, n in all_.items() if not (k[1] and item in k[1])})
    assert text(pipeline.keep_first_of_near_copies(spark, docs, "")) == all_
    cut = pipeline.cut_repeated_passages(spark, docs, "").collect()
    assert text(pipeline.cut_repeated_passages(spark, docs, "")) == all_ and all(x["n_chars"] == (None if x["text"] is None else len(x["text"])) for x in cut)
    assert substrings.WORDS.length == 51
