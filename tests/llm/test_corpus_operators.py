"""Contamination, near copies, toxicity, languages and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tracewell.llm import bpe, decontam, langid, neardup, queries, toxicity
from tracewell.llm.common import table
from tracewell.llm.words import hashed_words

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, texts, first=0):
    return spark.createDataFrame([(k + first, t, "en", "s", 1) for k, t in enumerate(texts)], COLUMNS)


def words_of(text):
    return re.findall(r"\w+", text.lower())


def shingles(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_word_hashes_do_not_depend_on_their_place():
    h, at = hashed_words(["The cat, sat!", "", "a THE Cat", "“the” cat é", "no"])
    assert at.tolist() == [0, 3, 3, 6, 9, 10] and h[0] == h[4] == h[6] and h[1] == h[5] == h[7] and len(set(h.tolist())) == 6


# -- contamination


def brute_contaminated(texts, items):
    return {(d, i) for d, t in enumerate(texts) for i, x in items.items() if shingles(x) and len(shingles(t) & shingles(x)) >= 0.8 * len(shingles(x)) - 1e-9 and words_of(x)}


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = {k: prose(rng, rng.randint(5, 60)) for k in range(30)}
    items |= {100: items[0], 101: "", 102: None, 103: "one two three"}
    texts = [prose(rng, 300) for _ in range(40)] + ["", None, "we say one two three today", "one two"]
    for k in range(25):
        w = items[k % 12].split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "zzz"
        texts[k] = texts[k][: rng.randint(0, 900)] + " " + ", ".join(w).upper() + " " + texts[k][900:]
    docs = rows(spark, texts)
    bench = spark.createDataFrame([(k, v) for k, v in items.items()] + [(None, "x y z")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench).collect()}
    want = {x for x in brute_contaminated([t or "" for t in texts], {k: v or "" for k, v in items.items() if k != 103})} | {(42, 103)}
    missing = want - set(got)
    assert not set(got) - want
    # what is missing lacks most of the question or of the answer
    assert all(min(m) < decontam.PART_OVERLAP for m in (decontam.ItemIndex([i], [items[i]]).verify(0, hashed_words([texts[d]])[0])[1:] for d, i in missing)) and len(missing) <= 2
    clean = decontam.clean(docs, bench)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in got} and clean.columns == docs.columns
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0


def test_no_item_is_below_its_bound():
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(6, 50)) for _ in range(60)]
    index = decontam.ItemIndex(list(range(60)), texts)
    for k in range(60):
        w = texts[k].split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "zz"
            t = " ".join(v)
            if len(shingles(t) & shingles(texts[k])) >= 0.8 * len(shingles(texts[k])):
                assert any(i == k for _, i, *_ in decontam.matches(index, [f"x y z {t} u v w"]))


def bm25_by_hand(items, text):
    """Scores of all items that share a word with the text, each distinct word of the text once."""
    full = {k: words_of(v) for k, v in items.items()}
    mean, held = np.mean([len(w) for w in full.values()]), Counter(t for w in full.values() for t in set(w))
    out = {}
    for k, w in full.items():
        for t in set(words_of(text)) & set(w):
            df, tf = held[t], w.count(t)
            out[k] = out.get(k, 0) + np.log(1 + (len(full) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return out


@pytest.mark.parametrize("n", [5, 4200])
def test_wand_finds_what_full_scoring_finds(n):
    """4,200 items make blocks of blocks of blocks."""
    rng = random.Random(n)
    common = [prose(rng, 1) for _ in range(60)]
    items = {k: " ".join(rng.choice(common) if rng.random() < 0.6 else prose(rng, 1) for _ in range(rng.randint(8, 30))) for k in range(n)}
    index = decontam.ItemIndex(list(items), list(items.values()))
    assert len(index.levels) == (1 if n == 5 else 3)
    texts = [" ".join(rng.choice(common) for _ in range(10)) + " " + items[rng.randrange(n)] + " " + items[rng.randrange(n)] for _ in range(25)]
    words, at = hashed_words(texts)
    got = {(w, i): s * index.bound[i] for w, i, s in index.candidates(index.terms(words), at[:-1], at[1:])}
    want = {(w, i): s for w, t in enumerate(texts) for i, s in bm25_by_hand(items, t).items() if s >= index.bound[i] * decontam.REACHED}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) >= 25


def test_scores_do_not_depend_on_shares(spark, monkeypatch):
    rng = random.Random(14)
    items = {k: prose(rng, rng.randint(8, 40)) for k in range(60)} | {60: None, 61: "..."}
    docs = rows(spark, [prose(rng, 20) + " " + items[k] for k in range(0, 60, 3)])
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    scores = []
    for chars in (10**9, sum(len(t or "") for t in items.values()) // 2 - 5):
        monkeypatch.setattr(decontam, "SHARE_CHARS", chars)
        scores.append({(r.doc_id, r.item_id): r.score for r in decontam.contaminated(docs, bench).collect()})
    assert len(scores[0]) == 20 and set(scores[0]) == set(scores[1]) and all(scores[0][k] == pytest.approx(scores[1][k]) for k in scores[0])


# -- near copies


def test_classes_equal_brute_force(spark):
    rng = random.Random(3)
    base = [prose(rng, rng.randint(30, 200)) for _ in range(60)]
    texts = list(base)
    for k in range(90):
        w = base[k % 30].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    texts += [base[0].upper() + "!", base[0], None, "", "...", "one two", "one, two", "two one"]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark, rows(spark, texts)).collect()}
    label = list(range(len(texts)))
    s = [shingles(t or "") for t in texts]
    for _ in range(len(texts)):
        for a in range(len(texts)):
            for b in range(a):
                # between 0.79 and 0.82 the weights decide
                if (words_of(texts[a] or "") == words_of(texts[b] or "")) or (s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])):
                    label[a] = label[b] = min(label[a], label[b])
        break
    near = [(a, b, len(s[a] & s[b]) / max(1, len(s[a] | s[b]))) for a in range(len(texts)) for b in range(a)]
    assert all(got[a] == got[b] for a, b, j in near if j >= 0.83 or words_of(texts[a] or "") == words_of(texts[b] or ""))
    assert all(got[a] != got[b] for a, b, j in near if j < 0.5 and label[a] != label[b] and not any(got[a] == got[c] and c not in (a, b) for c in range(len(texts))))
    assert all(got[got[k]] == got[k] <= k for k in got)


def test_a_large_group_of_near_copies_is_one_class(spark):
    rng = random.Random(9)
    origin = prose(rng, 300).split()
    texts = []
    for _ in range(1500):
        w = list(origin)
        for _ in range(3):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    texts += [prose(rng, 100) for _ in range(50)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark, rows(spark, texts)).collect()}
    assert {got[k] for k in range(1500)} == {0} and all(got[k] == k for k in range(1500, 1550))


def brute_classes(texts, spark):
    """The least number of each text's component under exact weighted similarities of all pairs."""
    docs = rows(spark, texts)
    idf = neardup.idf_table(*neardup.document_frequencies(docs))
    own = neardup.text_profiles(texts, idf)
    label = list(range(len(texts)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if len(own[a][0]) and len(own[b][0]) and neardup.weighted_jaccard(own[a], own[b]) >= neardup.SIMILARITY:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {k: root(k) for k in range(len(texts))}


@pytest.mark.parametrize("block", [6, 1024])
def test_a_group_without_an_origin_equals_brute_force(spark, monkeypatch, block):
    """Near copies of a text that is not there, of all similarities around the threshold; blocks so small that most pairs lie in different ones."""
    rng = random.Random(12)
    origin, other = prose(rng, 120).split(), prose(rng, 120).split()
    texts = list(dict.fromkeys(" ".join(prose(rng, 1) if rng.random() < share else w for w in base) for base in (origin, other) for share in (0.01, 0.015, 0.02, 0.03) for _ in range(20)))
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark, rows(spark, texts)).collect()}
    want = brute_classes(texts, spark)
    assert 4 < len(set(want.values())) < len(texts) - 20 and np.mean([got[k] == want[k] for k in want]) > 0.98


def test_cells_give_exact_similarities():
    rng = np.random.default_rng(5)
    pool = np.sort(rng.integers(1, 2**63, 300, dtype=np.uint64))
    idf = rng.uniform(1, 1.5, neardup.DF_BINS).astype(np.float32)

    def one():
        h = np.sort(rng.choice(pool, rng.integers(1, 250), replace=False))
        return h, rng.choice([1, 1, 1, 2, 3, 50], len(h)).astype(np.uint32), idf[neardup.bins_of(h, len(idf))]

    home, asking = [one() for _ in range(9)], [one() for _ in range(7)]
    got = neardup.cell_similarities(home, asking)
    want = [[neardup.weighted_jaccard((a, (1 + np.log(m)) * i), (b, (1 + np.log(n)) * j)) for b, n, j in home] for a, m, i in asking]
    assert np.allclose(got, want, atol=1e-5)
    labels = list(range(16))
    links = neardup.cell_links(labels, home + asking, list(range(9)), list(range(9, 16)), 0.3)
    assert 0 < len(links) < 16 and all(want[a - 9][b] >= 0.3 for a, b in links)


def test_complementary_words_are_two_classes(spark):
    from .test_text_operators import thue_morse

    got = neardup.near_duplicates(spark, rows(spark, list(thue_morse(1024)))).collect()
    assert {r.doc_id: r.class_id for r in got} == {0: 0, 1: 1}


def test_one_id_with_two_texts(spark):
    """Near copies of either text are of the id's class; an id with very many texts makes no pairs."""
    rng = random.Random(21)
    base = [prose(rng, 80).split() for _ in range(3)]

    def near(w):
        w = list(w)
        w[rng.randrange(80)] = "zz"
        return " ".join(w)

    texts = [(1, " ".join(base[0])), (1, " ".join(base[1])), (1, " ".join(base[2])), (5, near(base[0])), (6, near(base[1])), (7, near(base[2])), (8, prose(rng, 50)), (1, " ".join(base[1]))]
    texts += [(9, prose(rng, 30)) for _ in range(300)] + [(10, texts[-1][1])]
    d = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts], COLUMNS).repartition(3)
    assert {(r.doc_id, r.class_id) for r in neardup.near_duplicates(spark, d).collect()} == {(1, 1), (5, 1), (6, 1), (7, 1), (8, 8), (9, 9), (10, 1)}
    kept = sorted(tuple(r) for r in neardup.keep_one(spark, d).collect())
    assert [k for k, *_ in kept] == [1, 8, 9] and kept == sorted(tuple(r) for r in neardup.keep_one(spark, d.repartition(5)).collect())


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "y"), (1, "q r s t", "z"), (5, "Q r s t!", "u"), (None, "a b c", "v"), (7, None, None)], "doc_id long, text string, class_id string")
    assert sorted((r.doc_id, r.class_id) for r in neardup.near_duplicates(spark, d).collect()) == [(1, 1), (5, 1), (7, 7)]
    kept = neardup.keep_one(spark, d).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "7", "None"]
    assert neardup.near_duplicates(spark, d.limit(0)).count() == 0


def test_signatures_agree_as_often_as_weights_do():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(1, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    w = rng.uniform(0.5, 3, 1000).astype(np.float32)
    agree, exact = [], []
    for k in range(40):
        c, x, y = common[: 100 + 12 * k], a[k : k + 60], b[k : k + 60]
        first, second = (np.sort(np.concatenate((c, z))) for z in (x, y))
        wa, wb = (w[(z % np.uint64(1000)).astype(int)] for z in (first, second))
        s = neardup.signatures([first, second], [wa, wb])
        agree.append((s[0] == s[1]).mean())
        exact.append(neardup.weighted_jaccard((first, wa), (second, wb)))
    assert abs(np.mean(agree) - np.mean(exact)) < 0.03


# -- toxicity


@pytest.fixture(scope="module")
def restorer(spark):
    text = "idiot moron stupid scum loser worthless pathetic clown disgusting trash the sea and you are here to stay with them " * 50
    return toxicity.Restorer(toxicity.log_model(toxicity.trigram_counts([text])))


@pytest.mark.parametrize("written, meant", [("m0r0n", "moron"), ("st*pid", "stupid"), ("stuuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("$cum", "scum"), ("l0$er", "loser"), ("cl0wn", "clown"), ("d1sgust1ng", "disgusting"), ("1d10t", "idiot"), ("clean", "clean"), ("the&&&", "the")])
def test_restoring(restorer, written, meant):
    assert restorer.word(written) == meant


def exhaustive(r, written, gaps=None):
    """The best text over all paths of the lattice, one by one."""
    t, best = toxicity, (-np.inf, "")

    def walk(k, a, b, last, used, score, out):
        nonlocal best
        if k == len(written):
            best = max(best, (score + float(r.logp[a, b, 0]), out))
            return
        if gaps and k and not out.endswith("|"):
            wide = gaps[k - 1]
            walk_char(k, a, b, last, used, score + t.WITHIN[wide], out)
            if last:
                walk_char(k, b, 0, "", False, score + t.BETWEEN[wide] + float(r.logp[a, b, 0]), out + " ")
        else:
            walk_char(k, a, b, last, used, score, out)

    def walk_char(k, a, b, last, used, score, out):
        ch = written[k]
        reads = [(ch, t.ITSELF)] if ch.isalpha() else [(x, t.SIGN) for x in t.LEET.get(ch, "")]
        for letter, weight in reads:
            cost, x, y = r._cost(a, b, letter)
            walk(k + 1, x, y, letter, False, score + weight + cost, out + letter)
            if letter == last:
                walk(k + 1, a, b, last, True, score + t.COPY + (t.ITSELF if used else 0), out)
        if not reads or not ch.isalpha() and (ch in t.MARKS or ch in t.LEET):
            walk(k + 1, a, b, last, used, score + (t.LOST if ch in t.LEET else t.NOTHING), out)

    walk(0, 0, 0, "", False, 0.0, "")
    return best


def test_decoding_is_the_best_of_all_paths(restorer):
    rng = random.Random(7)
    for k in range(150):
        written = "".join(rng.choice("idotmrnscue10@$!.-*é") for _ in range(rng.randint(1, 8)))
        gaps = [rng.randint(0, 1) for _ in written[1:]] if k % 3 == 0 else None
        score, text = exhaustive(restorer, written, gaps)
        got = restorer.decode(written, gaps)
        assert got[1] == pytest.approx(score) and got[0].rstrip() == text.rstrip()


def test_learned_weights_equal_brute_force(spark):
    docs, labels, truth = toxic_tables(spark, 600)
    model = toxicity.train(spark, docs, labels)
    r, kept = toxicity.Restorer(model.logp), []
    text = {x.doc_id: x.text for x in docs.collect()}
    for k in sorted(truth):
        if zlib.crc32(str(k).encode()) % 5:
            words = set(r.words(text[k]))
            if not any(y == truth[k] and len(words & w) >= toxicity.ALIKE * len(words | w) for w, y in kept):  # random texts: none is like another
                kept.append((words, truth[k]))
    bad = sum(y for _, y in kept)
    good, found = len(kept) - bad, []
    counts = {}
    for words, y in kept:
        for f in {f for w in words for f in toxicity.features(w)}:
            counts.setdefault(f, [0, 0])[1 - y] += 1
    base = bad / (bad + good)
    for f, (t, n) in counts.items():
        if t >= toxicity.LEAST_DOCS:
            gain = t * np.log(t / ((t + n) * base)) + (n * np.log(n / ((t + n) * (1 - base))) if n else 0)
            weight = (np.log((t + 0.5) / (bad + 1)) - np.log((n + 0.5) / (good + 1))) * gain / (gain + toxicity.SHRINK)
            if weight > 0:
                found.append((f, weight, t, gain))
    least = np.log(max(1, len(found))) + toxicity.MARGIN
    want = toxicity.distinct_features([(f, w, t) for f, w, t, g in found if g >= least])
    assert set(want) == set(model.weights) and {"=idiot", "=moron", "=scum"} <= set(want) and all(model.weights[f] == pytest.approx(w) for f, w in want.items())


def test_only_verified_copies_count_once(spark):
    """Near copies of one toxic text teach no word; different texts with one word do."""
    rng = random.Random(30)
    origin = "zorro is a name and " + prose(rng, 30)
    docs = [(k, prose(rng, 40), 0) for k in range(400)] + [(400 + k, f"{origin} {prose(rng, 1)}", 1) for k in range(60)] + [(500 + k, prose(rng, 30) + " moron", 1) for k in range(60)]
    d = spark.createDataFrame([(k, t, "en", "s", 1) for k, t, _ in docs], COLUMNS)
    weights = toxicity.train(spark, d, spark.createDataFrame([(k, 1, y) for k, _, y in docs], "doc_id long, quality int, toxic int")).weights
    assert "=moron" in weights and "=zorro" not in weights


def test_restoring_letters_set_apart(restorer):
    assert restorer.restore("you are an i d i o t and m-o-r-o-n") .split() == ["you", "are", "an", "idiot", "and", "moron"]


def test_long_words_and_runs_are_restored(restorer):
    assert restorer.word("stu" + "u" * 100 + "pid") == "stupid" and "moron" in restorer.word("the.sea.and.you.are.here.to.stay.with.them." * 2 + "m0r0n")
    assert len(restorer.word("x" * 60_000)) >= 1 and restorer.word("@#" * 30_000)
    run = " ".join("idiot" * 12)
    assert restorer.joined(run).strip() != run


@pytest.mark.parametrize(
    "written, words",
    [
        ("you i\td\ti\to\tt here", ["idiot"]), ("you i\nd\ni\no\nt", ["idiot"]), ("what an a s s you are", ["ass"]), ("you id io t", ["idiot"]), ("i·d·i·o·t!", ["idiot"]), ("i•d•i•o•t", ["idiot"]), ("i / d / i / o / t", ["idiot"]),
        ("i\u200bd\u200bi\u200bo\u200bt", ["idiot"]), ("id\u00adiot", ["idiot"]), ("\u0456diot", ["idiot"]), ("idi\u043et and m\u03bfr\u03bfn", ["idiot", "moron"]), ("you: m,o,r,o,n", ["moron"]), ("m_o_r_o_n", ["moron"]),
    ],
)
def test_other_gaps_and_letters_are_restored(written, words):
    text = "you are an idiot and a moron , an ass and a clown with the sea here to stay , it is as of to be or do so " * 50
    r = toxicity.Restorer(toxicity.log_model(toxicity.trigram_counts([text])))
    assert set(words) <= set(r.words(written))


@pytest.mark.parametrize("clean", ["it is as it is to be so", "a b c", "1 2 3 4 5 6", "1\n2\n3\n", "is it ok to do so", "привет, это слово", "we go to it"])
def test_clean_text_says_what_it_said(clean):
    text = "you are an idiot and a moron , it is as it is to be so , is it ok to do so , we go to it , a b c " * 50
    r = toxicity.Restorer(toxicity.log_model(toxicity.trigram_counts([text])))
    assert not {"idiot", "moron", "ass"} & set(r.words(clean)) and set(re.findall("[^\\W\\d_]{2,}", clean)) <= set(r.words(clean))


def test_labelled_rows_of_one_id_are_one(spark):
    docs, labels, _ = toxic_tables(spark, 200)
    more = docs.where("doc_id = 7").crossJoin(spark.range(300)).select(docs.columns)
    one, many = (toxicity.train(spark, d, labels) for d in (docs, docs.unionByName(more)))
    # the corpus counts see the copies, the classifier doesn't
    assert set(one.weights) == set(many.weights) and one.weights


@pytest.mark.parametrize("written, words", [("you are a m o r o n", ["a", "moron"]), ("y o u  a r e  a n  i d i o t", ["you", "are", "an", "idiot"]), ("y o u a r e a n i d i o t", ["idiot"]), ("you idio7", ["idiot"])])
def test_spaced_words_are_cut_where_words_end(spark, written, words):
    text = "you are an idiot and a moron , you are a clown and an idiot with the sea here to stay " * 50
    assert set(words) <= set(toxicity.Restorer(toxicity.log_model(toxicity.trigram_counts([text]))).words(written))


def toxic_tables(spark, n=1500):
    rng, bad = random.Random(6), ["idiot", "moron", "scum"]
    vocabulary = [prose(rng, 1) for _ in range(4000)]
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.15)
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(bad)
        docs.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, 1, toxic))
    docs += [(n, "you absolute m0r0n of a man", "en", "s", 1), (n + 1, None, None, None, None), (n + 2, "", "en", "s", 0), (None, "moron", "en", "s", 1)]
    labels += [(n + 5, 1, 1), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: y for k, _, y in labels[:n]}


def test_toxicity_of_held_out_rows(spark):
    docs, labels, truth = toxic_tables(spark)
    out = toxicity.toxicity(spark, docs, labels).collect()
    assert len(out) == len(truth) + 4
    got = {r.doc_id: r for r in out}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in held) for k in truth) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert np.mean([got[k].predicted == truth[k] for k in held]) > 0.98
    assert got[len(truth)].predicted == 1 and got[len(truth) + 1].predicted == 0 and got[len(truth) + 1].score == got[len(truth) + 2].score


def test_counts_and_rows_are_handed_on_in_parts(spark, monkeypatch):
    """Features counted in many parts give the same model; rows with their texts leave a task run by run, not a batch at a time."""
    docs, labels, _ = toxic_tables(spark, 200)
    whole = toxicity.train(spark, docs, labels)
    monkeypatch.setattr(toxicity, "KEPT_FEATURES", 20)
    parts = toxicity.train(spark, docs, labels)
    assert parts.weights == whole.weights and (parts.slope, parts.bias) == (whole.slope, whole.bias)
    runs = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: runs.append((f, self.toArrow().combine_chunks().to_batches()[0])))
    for module, call in ((toxicity, lambda: toxicity.score(docs, whole, ("doc_id", "text"))), (langid, lambda: langid.predict(docs, ["en", "de"], np.zeros((langid.BUCKETS + 1, 2)), ("doc_id", "text")))):
        monkeypatch.setattr(module, "CHUNK_CHARS", 1000)
        call()
        f, batch = runs.pop()
        out = list(f(iter([batch])))
        assert len(out) > 5 and [i for b in out for i in b.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_toxicity_of_little_data(spark):
    docs, labels, _ = toxic_tables(spark, 30)
    none = toxicity.toxicity(spark, docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} <= {0, 1} and len(none) == 34
    assert toxicity.toxicity(spark, docs.limit(0), labels).count() == 0


# -- languages


def test_languages_of_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = langid.identify(docs).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_scores_are_those_of_naive_bayes():
    rng = random.Random(2)
    texts = [prose(rng, 30) for _ in range(6)] + ["", "12 34", "é"]
    grams, at = langid.ngram_buckets(texts)
    matrix = np.log(np.random.default_rng(0).dirichlet([1.0] * 3, langid.BUCKETS + 1)).astype(np.float32)
    names, scores = langid.score_texts(texts, ["a", "b", "c"], matrix)
    for k, t in enumerate(texts):
        own = [g[at[k] : at[k + 1]] for g in grams]
        counted = langid.ngram_buckets([t])[0]
        assert [x.tolist() for x in own] == [x.tolist() for x in counted]
        total = matrix[-1].astype(float) + sum(matrix[b].astype(float) for x in own for b in x if b >= 0)
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        if any(c.isalpha() for c in t):
            assert names[k] == "abc"[p.argmax()] and scores[k] == pytest.approx(p.max())
        else:
            assert (names[k], scores[k]) == ("und", 0)


def test_odd_languages(spark):
    d = spark.createDataFrame([(1, None, "en", "x"), (2, "... 12", None, "y"), (None, "the cat", None, "z"), (3, "the cat sat", "en", None), (4, "der hund", "de", None)], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[None].held_out is False and len(got) == 5
    unlabelled = spark.createDataFrame([(1, "the cat", None), (2, "", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(unlabelled).collect()} == {("und", 0.0)} and langid.identify(d.limit(0)).count() == 0


# -- the pipeline


def test_each_stage_against_its_operator(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if k < 4:
            assert docs.columns == corpus_pipeline.DOCUMENT_COLUMNS
            assert docs.join(before, docs.columns, "left_semi").count() == docs.count()
        was = {r.doc_id: r.text for r in before.collect()}
        if name == "near_copies":
            classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark, before).collect()}
            assert kept[name] == set(classes.values())
        if name == "contamination":
            items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
            texts = list(was.values())
            assert set(was) - kept[name] == {list(was)[d] for d, _ in brute_contaminated(texts, items)}
        if name == "encode":
            assert kept[name] == set(was)
            want = {r.doc_id: r.ids_sha256 for r in bpe.bpe_digests(before, bpe.tokenizer_text()).collect()}
            assert {r.doc_id: r.ids_sha256 for r in docs.collect()} == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == kept["encode"]


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, name, stage):
    """Nulls in any column, empty and long texts, repeated rows, more columns with names that operators use, and no rows."""
    odd = [None, "", "...", "a", "the cat the cat", "word " * 30_000, "x" * 60_000, "é ñ ß 日本", "the cat the cat"]
    rows = [(k, t, None, None, None, 0.5, 1, "z", "b") for k, t in enumerate(odd)] + [(None, "the dog sat", "en", "s", 1, None, None, None, None), (4, odd[4], "en", "s", 1, 1.0, 1, "y", "c")]
    d = spark.createDataFrame(rows, COLUMNS + ", score double, predicted int, sig string, bands string")
    out = stage(spark, d, SF).collect()
    ids = [r.doc_id for r in out]
    if name == "encode":
        assert len(out) == len(rows)
    else:
        assert list(out[0].asDict()) == corpus_pipeline.DOCUMENT_COLUMNS and None in ids or name == "language"
        kept = {"toxicity": {*range(9)}, "language": set(), "near_copies": {0, 3, 4, 5, 6, 7}, "contamination": {*range(9)}}[name]
        assert kept <= {i for i in ids if i is not None}
    if name == "near_copies":
        assert ids.count(4) == 1 and 8 not in ids and 1 not in ids and 2 not in ids
    assert stage(spark, d.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_every_row(spark, name):
    got = queries.QUERIES[name](spark, SF)
    n = got.count()
    if name.startswith(("op5", "op9")):
        assert n > 0
    else:
        assert n == table(spark, SF, "pages" if name.startswith("op10") else "documents").count()
