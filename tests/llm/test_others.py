"""Language mixtures, revisits, quality rules, packing, sharding and mixing."""

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimweave.llm import language_id, mixing, packing, quality, revisits, sharding
from claimweave.llm.queries import QUERIES
from tests.llm.messy import LONG, POEM, ROWS, empty, frame, words

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# --- language ------------------------------------------------------------------


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language_id.identify(docs, language_id.learn_from(docs), ["doc_id", "lang"])
    held = found.where(language_id.held_out(F.col("row.doc_id")))
    right, rows = held.agg(F.sum((F.col("lang_pred") == F.col("row.lang")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * rows > 0


def model(spark, docs):
    return language_id.learn_from(docs)


def test_language_learns_only_from_the_rest(spark):
    docs = frame(spark)
    taught = language_id.learn_from(docs)
    expected = {}
    for doc_id, text, lang, _ in ROWS:
        if doc_id is not None and lang and text and zlib.crc32(str(doc_id).encode()) % 4 != 2:
            found, counts = language_id.trigrams(text)
            if len(found):
                expected.setdefault(lang, np.zeros(language_id.BUCKETS))[found] += counts
    assert taught.languages == sorted(expected)
    for i, lang in enumerate(taught.languages):
        smoothed = expected[lang] + language_id.SMOOTHING
        assert np.allclose(taught.log_p[:, i], np.log(smoothed / smoothed.sum()))


def brute_mixture(model, found, counts):
    """Expectation-maximisation one trigram at a time, then the penalised choice."""
    p = np.exp(model.log_p[found] - model.log_p[found].max(axis=1, keepdims=True))
    k, total = p.shape[1], counts.sum()

    def fit(allowed):
        share = np.array([1 / len(allowed) if i in allowed else 0.0 for i in range(k)])
        for _ in range(language_id.ROUNDS):
            new = np.zeros(k)
            for row, c in zip(p, counts):
                new += c * row * share / (row @ share)
            share = new / total
        return share, sum(c * np.log(row @ share) for row, c in zip(p, counts))

    order = np.argsort(-fit(range(k))[0], kind="stable")
    best, value = None, -np.inf
    for size in range(1, k + 1):
        share, likelihood = fit(order[:size])
        likelihood -= size * (0.5 * np.log(max(total, 2)) + np.log(k))
        if likelihood <= value:
            break
        best, value = share, likelihood
    return best


def test_mixture_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taught = language_id.learn_from(docs)
    texts = [r.text for r in docs.select("text").limit(12).collect()]
    mixed = [texts[0][:300] + texts[i][:300] for i in range(12)]
    found = [language_id.trigrams(t[:2000]) for t in texts + mixed]
    got = language_id.mixtures(taught, found)
    for row, (buckets, counts) in zip(got, found):
        assert np.allclose(row, brute_mixture(taught, buckets, counts), atol=1e-9)


def test_two_languages(spark):
    english, german = "the cat and the dog went over the road to sleep under that tree " * 3, "der Hund und die Katze gehen über die Straße und schlafen unter dem Baum " * 3
    docs = frame(spark, [(i, t, lang, "s") for i, (t, lang) in enumerate([(english, "en"), (german, "de")] * 8)], clash=False)
    both = frame(spark, [(1, english + german, None, None), (2, english, None, None)])
    got = {r.doc_id: r for r in language_id.identify(both, language_id.learn_from(docs)).select("row.doc_id", "lang_pred", "score", "languages").collect()}
    assert {x.lang for x in got[1].languages} == {"en", "de"} and 0.3 < got[1].score < 0.7
    assert got[2].lang_pred == "en" and got[2].score == 1.0


def test_language_of_awkward_rows(spark):
    docs = frame(spark)
    got = language_id.identify(docs, language_id.learn_from(docs)).select("row.*", F.col("lang_pred").alias("found"), F.col("score").alias("points")).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert (r.found == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.points <= 1
    assert {r.found for r in language_id.identify(docs, language_id.learn(empty(spark))).select(F.col("lang_pred").alias("found")).collect()} == {"und"}
    assert language_id.identify(empty(spark), language_id.learn(docs)).count() == 0


# --- revisits ------------------------------------------------------------------


def record(id_, url, at, kind, status, headers, body=None):
    return (id_, url, at, kind, status, headers, body, "own")


SCHEMA = "record_id string, url string, at bigint, kind string, status int, headers map<string,string>, body string, met string"


def test_revisits(spark):
    u = "http://www.Example.com:80/a/"
    rows = [
        record("r1", u, 10, "response", 200, {"etag": '"1"', "server": "x", "date": "d1"}, "one"),
        record("r2", u, 20, "response", 200, {"etag": '"2"', "server": "y", "date": "d2"}, "two"),
        record("r3", u, 20, "response", 404, {"etag": '"3"'}, "gone"),
        record("r4", "https://other.org/?utm_source=a", 5, "response", 200, {"last-modified": "m"}, ""),
        record("v1", "https://example.com/a#top", 15, "revisit", 304, {"etag": 'W/"1"', "date": "d9", "set-cookie": "no"}),
        record("v2", "https://example.com/a", 20, "revisit", 304, {"etag": '"2"'}),  # r2 is not earlier
        record("v3", "https://example.com/a", 21, "revisit", 304, {"etag": '"2"'}),
        record("v4", "https://example.com/a", 9, "revisit", 304, {"etag": '"1"'}),
        record("v5", "http://other.org", 6, "revisit", 304, {"last-modified": "m"}),
        record("v6", "http://other.org", 7, "revisit", 304, None),
        record("v7", None, 7, "revisit", 304, {"etag": "x"}),
        record("v8", "not a url", 7, "revisit", 304, {"etag": "x"}),
        record("v3", "https://example.com/a", 21, "revisit", 304, {"etag": '"2"'}),
    ]
    got = revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.record_id: r for r in got}
    assert len(got) == 9
    assert {k: (v.outcome, v.source_id, v.body) for k, v in by.items()} == {
        "v1": ("resolved", "r1", "one"), "v2": ("changed", "r1", None), "v3": ("resolved", "r2", "two"), "v4": ("no_response", None, None),
        "v5": ("resolved", "r4", ""), "v6": ("no_validator", "r4", None), "v7": ("no_url", None, None), "v8": ("no_url", None, None),
    }
    assert by["v1"].headers == {"etag": 'W/"1"', "server": "x", "date": "d9"}
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_revisit_gets_the_body_it_met(spark):
    """Responses without id, with the id of another URL's response, and twice over: a row per revisit, and always the right body."""
    a, b, c = "http://a.org/x", "http://b.org/x", "http://c.org/x"
    rows = [
        record(None, a, 1, "response", 200, {"etag": "1"}, "body of a"),
        record("same", b, 1, "response", 200, {"etag": "1"}, "body of b"),
        record("same", c, 1, "response", 200, {"etag": "1"}, "body of c"),
        record("same", c, 1, "response", 200, {"etag": "1"}, "body of c"),
        record("same", c, 5, "response", 200, {"etag": "1"}, "later body of c"),
        record("va", a, 2, "revisit", 304, {"etag": "1"}),
        record("vb", b, 2, "revisit", 304, {"etag": "1"}),
        record("vc", c, 2, "revisit", 304, {"etag": "1"}),
        record("vd", c, 6, "revisit", 304, {"etag": "1"}),
        record(None, c, 6, "revisit", 304, {"etag": "1"}),
        record("vn", c, None, "revisit", 304, {"etag": "1"}),
    ]
    got = [(r.record_id, r.outcome, r.source_id, r.body) for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([
        ("va", "resolved", None, "body of a"), ("vb", "resolved", "same", "body of b"), ("vc", "resolved", "same", "body of c"),
        ("vd", "resolved", "same", "later body of c"), (None, "resolved", "same", "later body of c"), ("vn", "no_response", None, None),
    ], key=str)


def test_captures_need_the_join(spark, sf_dir):
    """In the query's captures all outcomes occur, and at least a fifth of the revisits meets another page's response."""
    found = QUERIES["op3_revisits"](spark, sf_dir).collect()
    assert {r.outcome for r in found} == {"resolved", "changed", "no_validator", "no_url", "no_response"}
    own = lambda r: r.source_id is not None and int(r.source_id[1:]) in (int(r.record_id[1:]), int(r.record_id[1:]) - 1)
    assert sum(r.source_id is not None and not own(r) for r in found) >= 0.2 * len(found)
    bodies = [r for r in found if r.outcome == "resolved"]
    assert bodies and all(r.body_sha256 for r in bodies) and any(r.source_id is None for r in bodies)


def test_one_url_over_many_partitions(spark):
    """A hot URL spans range partitions; what stands before a border is carried over it."""
    rows = [record(f"r{i}", "http://a.b/c", 100 * i, "response", 200, {"etag": str(i)}, f"body {i}") for i in range(5)]
    rows += [record(f"v{i}", "http://a.b/c", i, "revisit", 304, {"etag": str((i - 1) // 100)}) for i in range(1, 500)]
    got = revisits.resolve(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert len(got) == 499 and all(r.outcome == "resolved" and r.body == f"body {(int(r.record_id[1:]) - 1) // 100}" for r in got)


# --- quality -------------------------------------------------------------------


def test_measures():
    t = quality.Text("a b c d e f a b c d e g\n# x\n# x\n \n \n|")
    assert (t.n_words, t.n_symbols, t.n_dup_lines, t.word_chars) == (17, 3, 1, 17)
    assert t.n_repeat_words == 10


def test_repeat_words_against_brute_force():
    rng = np.random.default_rng(3)
    for n, kinds in ((4, 2), (5, 1), (30, 2), (400, 4), (9000, 5000)):
        w = [str(x).encode() for x in rng.integers(0, kinds, n)]
        w += w[: n // 3]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        again = {i + k for i, g in enumerate(grams) for k in range(5) if n < 1000 and grams.count(g) > 1}
        if n < 1000:
            assert quality.repeat_words(w) == len(again)
        else:
            assert quality.repeat_words(w) >= 2 * (n // 3)


def test_cascade_order_does_not_change_what_is_kept(spark):
    docs = frame(spark)
    names = [r.name for r in quality.RULES]
    one = quality.cascade(docs, order=names).select("row.doc_id", "row.text", "kept", "base_failed", "n_words")
    other = quality.cascade(docs, order=names[::-1]).select("row.doc_id", "row.text", "kept", "base_failed", "n_words")
    estimated = quality.cascade(docs).select("row.doc_id", "row.text", "kept", "base_failed", "n_words")
    key = lambda f: sorted(map(str, f.collect()))
    assert key(one) == key(other) == key(estimated)
    for r in one.collect():
        assert r.n_words == len(words(r.text)) and r.base_failed >= (r.n_words < 10)
    assert quality.cascade(empty(spark)).count() == 0


def test_cascade_prefers_rejections_per_second(spark):
    def slow(t):
        sum(range(20_000))
        return True

    rules = [quality.Rule("never", lambda t: False), quality.Rule("slow", slow), quality.Rule("quick", lambda t: True)]
    docs = frame(spark, [(i, POEM, None, None) for i in range(50)])
    assert [name for name, _, _ in quality.estimate(docs, rules)][0] == "quick"
    assert {r.rejected_by for r in quality.cascade(docs, rules).collect()} == {"quick"}


def test_rules_are_weighed_among_survivors(spark):
    """A rule that only rejects what the base or an earlier rule rejects comes last, however often it rejects."""

    def slow(reject):
        def rule(t):
            sum(range(3000))
            return reject(t)

        return rule

    start = lambda c: slow(lambda t: t.text.startswith(c))
    words_ = " ".join(f"w{j}" for j in range(20))
    rows = [(i, "abc"[i % 3] * 3 + " " + words_, None, None) for i in range(60)] + [(100 + i, "zzz", None, None) for i in range(300)]
    rules = [quality.Rule("short", lambda t: t.n_words < 10), quality.Rule("a_or_b", slow(lambda t: t.text[0] in "ab")), quality.Rule("a", start("a")), quality.Rule("c", start("c"))]
    order = [(name, share) for name, _, share in quality.estimate(frame(spark, rows), rules)]
    assert [name for name, _ in order if name not in ("short",)] == ["a_or_b", "c", "a"]
    shares = dict(order)
    assert shares["short"] == 0 and shares["a"] == 0 and shares["c"] == 1.0 and abs(shares["a_or_b"] - 2 / 3) < 0.01


# --- packing -------------------------------------------------------------------


def check_pieces(rows, docs, window):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(TOKENIZER)
    encoder.encode_special_tokens = True
    wanted = sorted((str(i), encoder.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in docs)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(str(r.doc_id), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) <= window
    seen = []
    for name, pieces in by_doc.items():
        same = [ids for i, ids in wanted if i == name]
        assert sum(p.length for p in pieces) == sum(map(len, same))
        for p in pieces:
            assert any(zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 and len(ids) == p.doc_tokens for ids in same)
        seen.append(name)
    assert sorted(seen) == sorted({i for i, _ in wanted})
    return len(by_seq)


def test_packing_keeps_every_id(spark):
    rows = [(r[0], r[1]) for r in ROWS]
    got = packing.pack(frame(spark).coalesce(1), TOKENIZER, window=512, block_windows=4).collect()
    check_pieces(got, rows, 512)
    assert packing.pack(empty(spark), TOKENIZER).count() == 0


def test_packing_wastes_little(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = packing.pack(docs, TOKENIZER).collect()
    used = check_pieces(got, [(r.doc_id, r.text) for r in docs.collect()], 4096)
    assert used * 4096 <= 1.03 * sum(r.length for r in got) + 4096


def test_differencing_balances():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 500).tolist()
    part = packing.differencing(sizes, 20)
    loads = np.bincount(part, weights=sizes, minlength=20)
    assert loads.sum() == sum(sizes) and loads.max() - loads.min() < 0.02 * loads.mean()
    assert packing.differencing([5], 1).tolist() == [0]


def test_special_names_are_ordinary_text():
    encoder = packing.Encoder(TOKENIZER)
    assert 49407 not in np.frombuffer(next(encoder.encode(["a <|endoftext|> b"])), "<u4").tolist()


class CountingTokenizer:
    """Passes on to a tokenizer and counts the calls and the texts in them."""

    def __init__(self, inner):
        self.inner, self.calls, self.texts = inner, 0, 0

    def encode_batch_fast(self, texts, **options):
        self.calls += bool(texts)
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **options)


def test_new_words_of_many_texts_reach_the_tokenizer_together():
    rng = np.random.default_rng(7)
    made = ["".join(rng.choice(list("abcdeéüñß"), 9)) for _ in range(6000)]
    texts = [" ".join(w + ("", ",", "###")[j % 3] for j, w in enumerate(made[i : i + 20])) for i in range(0, 6000, 20)]
    encoder = packing.Encoder(TOKENIZER)
    plain = encoder._tokenizer
    wanted = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    encoder._tokenizer = counting = CountingTokenizer(plain)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == wanted
    assert counting.calls <= 4 and counting.texts <= 200


def test_ids_are_those_of_whole_texts(monkeypatch):
    rng = np.random.default_rng(8)
    odd = [chr(c) for c in range(0x80, 0x180)] + list("aZbE9.,;:!?*#$%&'<|>-_ \t\n\r\x0b\x0c\x00\x1c\x1f\x7f\u0301\u0307\u0958\u03a3\u0130\u00a0\u3000\u2028ЖД中ﬁ😀")
    texts = ["".join(rng.choice(odd, int(rng.integers(0, 40)))) for _ in range(1500)]
    texts += [f"{c}{c}, x{c}y!! {c.upper()}. O{c}'s" for c in odd] + [None, "", " ", "\n\n", "Ab" * 4000 + ",", "é" * 100 + "## é"]
    plain = packing.Encoder(TOKENIZER)._tokenizer
    wanted = [e.ids for e in plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for size, remembered, joined in ((4 << 20, 400_000, 64), (300, 50, 3), (1, 5, 1)):
        monkeypatch.setattr(packing.Encoder, "SLICE", size)
        monkeypatch.setattr(packing.Encoder, "REMEMBERED", remembered)
        monkeypatch.setattr(packing.Encoder, "JOINED", joined, raising=False)
        encoder = packing.Encoder(TOKENIZER)
        for given in (texts, pa.array(texts, pa.string()), pa.array(texts, pa.large_string())):
            assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(given)] == wanted
        encoder._ends[:] = False  # a vocabulary without a mark of the ends
        encoder._known, encoder._older = {}, {}
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == wanted


# --- sharding ------------------------------------------------------------------


def test_shards_match_the_mixture(spark):
    rows = [(i, f"text {i}", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(2000)] + [(5, "text 5", "en", None)] * 3
    got = sharding.assign(frame(spark, rows), shards=8).collect()
    assert len(got) == len(rows)
    for shard in range(8):
        mine = [r for r in got if r.shard == shard]
        assert len(mine) in (len(rows) // 8, len(rows) // 8 + 1)
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        for source in {r.source for r in got}:
            everywhere = sum(r.source == source for r in got)
            assert abs(sum(r.source == source for r in mine) - everywhere / 8) <= 2
    again = sharding.assign(frame(spark, rows).repartition(5), shards=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shard_rows_keeps_every_row(spark):
    got = sharding.shard_rows(frame(spark), shards=3)
    assert sorted(map(str, got.select("row.doc_id", "row.text", "row.shard").collect())) == sorted(map(str, frame(spark).select("doc_id", "text", "shard").collect()))
    assert sharding.assign(empty(spark)).count() == 0 and sharding.shard_rows(empty(spark)).count() == 0


# --- mixing --------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    wanted, fixed = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (wanted - sum(fixed.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: float(fixed.get(s, level * weight[s])) for s in names}
        fixed |= {s: 2 * sizes[s] for s in over}


def test_targets_match_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(0, 50)), None, source) for i, source in enumerate([*"abcdefghij", None, "é", "hot", "hot", "hot"] * 6)]
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    got = {r.source: r.target for r in mixing.source_targets(frame(spark, rows)).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_copies_follow_the_rates(spark):
    rows = [(i, "a b c d", None, "abcd"[i % 4]) for i in range(4000)]
    got = mixing.repetitions(frame(spark, rows)).collect()
    taken = {}
    for r in got:
        taken[r.row.source] = taken.get(r.row.source, 0) + r.size * r.copies
        assert 0 <= r.copies <= 2
    for r in got:
        assert abs(taken[r.row.source] - r.target) < 0.1 * r.target
    assert mixing.mix(frame(spark, rows)).count() == sum(r.copies for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.repetitions(frame(spark, rows).repartition(3)).collect()))


def test_mix_of_awkward_rows(spark):
    docs = frame(spark)
    assert mixing.repetitions(docs).count() == len(ROWS)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.repetitions(frame(spark, [(1, None, None, "a"), (2, "", None, "b")])).agg(F.sum("copies")).first()[0] == 0


def test_long_text_is_counted_whole(spark):
    row = mixing.repetitions(frame(spark)).where("row.doc_id = 7").first()
    assert row.size == len(words(LONG))
