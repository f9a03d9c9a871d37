import math
import random
from collections import Counter

from inkwell.llm.distinctive import most_distinctive, term_scores
from inkwell.llm.term_counts import BurstTrie, count_terms, mark_terms, route_of
from inkwell.llm.words import listed_words, words_of

TEXTS = ["Red cat, RED dog_cat", "", None, "été 42 été x²", "cat " * 50, "İstanbul ab12", "red cat, red dog_cat"]


def test_burst_trie_counts_like_a_dict():
    rnd = random.Random(2)
    trie, want = BurstTrie(4), Counter()
    for _ in range(4000):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 7)))
        trie.add(word, 2, 1)
        want[word] += 1
    assert {t: (o, r) for t, o, r in trie.terms()} == {w: (2 * n, n) for w, n in want.items()}
    assert trie.size == len(want) and all(len(c) <= 4 for _, c, _ in trie.containers())


def test_routes_are_prefixes_and_agree():
    inner = frozenset({"", "a", "ab"})
    assert [route_of(w, inner) for w in ("", "a", "ab", "abc", "abcd", "ax", "b")] == ["", "a", "ab", "abc", "abc", "ax", "b"]


def frame(spark, texts, n=3):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key bigint, text string").repartition(n)


def test_counts_against_brute_force(spark):
    rnd = random.Random(3)
    texts = TEXTS + [" ".join(f"w{int(rnd.paretovariate(0.7)) % 900}" for _ in range(40)) for _ in range(80)]
    occurrences, records = Counter(), Counter()
    for t in texts:
        occurrences.update(words_of(t or ""))
        records.update(set(words_of(t or "")))
    got = {r.term: (r.occurrences, r.records) for r in count_terms(frame(spark, texts, 5)).collect()}
    assert got == {w: (n, records[w]) for w, n in occurrences.items()}
    assert count_terms(frame(spark, texts).limit(0)).count() == 0


def test_same_counts_whatever_the_routes_and_bounds(spark, monkeypatch):
    df = frame(spark, TEXTS + [" ".join(f"t{i}" for i in range(300))])
    one = {tuple(r) for r in count_terms(df).collect()}
    monkeypatch.setattr("inkwell.llm.term_counts.HELD", 20)
    monkeypatch.setattr("inkwell.llm.term_counts.SAMPLE", 1)
    again = count_terms(df).collect()
    assert one == {tuple(r) for r in again} and len(again) == len(one)


def test_scores_whatever_is_hot(spark):
    df = frame(spark, TEXTS)
    vocabulary = spark.createDataFrame([("cat",), ("42",), ("ab12",)], "word string")
    for words in (None, vocabulary):
        one, two = ({tuple(r) for r in term_scores(df, words, hottest=n).collect()} for n in (1, 1000))
        assert one == two and one


def test_marks_and_listed_words(spark):
    idf = spark.createDataFrame([(" Red ", 1.0), ("red", None), (None, 2.0), ("  ", 1.0), ("nowhere", float("nan")), ("cat\n", -1.0)], "word string, idf double")
    words = listed_words(idf)
    assert {r.word for r in words.collect()} == {"red", "nowhere", "cat"}
    counts = spark.createDataFrame([("red", 9, 4), ("cat", 60, 8)], "term string, occurrences bigint, records bigint")
    total = spark.createDataFrame([(10,)], "n bigint")
    assert {(r.word, r.occurrences, r.records, r.mark) for r in mark_terms(words, counts, total).collect()} == {("red", 9, 4, None), ("cat", 60, 8, "common"), ("nowhere", 0, 0, "rare")}


def test_scores_against_brute_force(spark):
    texts = [t for t in TEXTS] + ["solo solo solo solo cat"]
    counts = {i: Counter(words_of(t or "")) for i, t in enumerate(texts)}
    df = Counter(w for c in counts.values() for w in c)
    n = len(texts)
    got = {(r.key, r.word): (r.tf, r.df, r.length, r.score) for r in term_scores(frame(spark, texts)).collect()}
    assert set(got) == {(i, w) for i, c in counts.items() for w in c}
    for (i, w), (tf, d, length, score) in got.items():
        assert (tf, d, length) == (counts[i][w], df[w], sum(counts[i].values()))
        assert math.isclose(score, tf / length * (math.log((1 + n) / (1 + d)) + 1))


def test_most_distinctive_breaks_ties_by_word(spark):
    texts = ["b b a a", "c", "c d"]
    rows = most_distinctive(term_scores(frame(spark, texts), smooth=False, normalise=False))
    assert {(r.key, r.word) for r in rows.collect()} == {(0, "a"), (1, "c"), (2, "d")}
    vocabulary = spark.createDataFrame([("b",), ("c",)], "word string")
    rows = most_distinctive(term_scores(frame(spark, texts), vocabulary, smooth=False, normalise=False))
    assert {(r.key, r.word) for r in rows.collect()} == {(0, "b"), (1, "c"), (2, "c")}


def test_scores_of_odd_tables(spark):
    rows = [(1, "a b", "x"), (1, "a", "y"), (None, "a", "z"), (2, None, "z"), (3, "", "z")]
    got = term_scores(spark.createDataFrame(rows, "key bigint, text string, word string"), smooth=False, normalise=False).collect()
    assert {(r.key, r.word, r.tf, r.df, r.length) for r in got} == {(1, "a", 2, 1, 3), (1, "b", 1, 1, 3)} and math.isclose(got[0].score, got[0].tf * math.log(3))
    assert term_scores(frame(spark, ["a"]).limit(0)).count() == 0
