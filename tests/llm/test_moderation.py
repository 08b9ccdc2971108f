from __future__ import annotations

import dataclasses

import numpy as np
import pytest

from tessella.llm import moderation as M

CLEAN = ["The valve {} is pushed over the seat and turned by 3 mm.", "A grease nipple {} is screwed into the joint.", "Terms such as idiot in the word list {} are mapped to a class.", "Vermin such as rats are kept away from hopper {} by a grid.", "The housing {} of steel reduces the noise."]
BAD = [("abusive", "The examiner is a {} {} and always was."), ("abusive", "You {} {}, shut your mouth."), ("hateful", "Those {} people are vermin and must be driven out."), ("sexual", "She sucked his {} cock until he moaned.")]
ADJ, NOUN = ["stupid", "worthless", "filthy", "useless"], ["idiot", "moron", "loser", "pig"]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(0)
    rows = [(CLEAN[i % 5].format(rng.integers(1, 400)), "clean") for i in range(120)]
    for i in range(120):
        kind, t = BAD[i % 4]
        text = t.format(ADJ[rng.integers(4)], NOUN[rng.integers(4)])
        rows.append((CLEAN[i % 5].format(7) + " " + text if i % 3 == 0 else text, kind))
    return M.train(rows, M.Background(frozenset(["the", "valve", "housing"])), rounds=80)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    p, edge = M.forward_backward(emit, np.ones((1, 4), bool), trans, edges=True)
    want, pairs, z = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(emit[0, i, s] for i, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        z += w
        for i, s in enumerate(path):
            want[i, s] += w
        for a, b in zip(path, path[1:]):
            pairs[a, b] += w
    assert np.allclose(p[0], want / z) and np.allclose(edge, pairs / z)


def test_odd_spellings():
    r = M.Reader()
    for raw, form in (("M0R0N,", "moron"), ("i_d_i_o_t", "idiot"), ("n.a.k.e.d", "naked"), ("j@ck4$s", "jackass"), ("ma​sturbate", "masturbate"), ("VЕRMІN,", "vermin"), ("ddddick", "dick"), ("b*****d.", "bastard"), ("FILTTTTTH", "filth"), ("naïve", "naive")):
        assert r.read(raw)[0] == form, raw
    assert r.read("second-cut")[0] == "second-cut" and r.read("S222")[0] == "" and not r.read("B-B.")[2]


def test_scores_spans_and_rates(spark, model):
    rows = [
        (1, "The housing 5 of steel reduces the noise. You stupid idiot, shut your mouth. The valve 3 is pushed over the seat and turned by 3 mm.", "a", "x"), (2, "Terms such as idiot in the word list 4 are mapped to a class.", "a", "x"),
        (3, None, None, "x"), (4, "", "b", "x"), (5, "  \n", "b", "x"), (6, "The valve 8 is pushed over the seat and turned by 3 mm. " * 4000 + "The examiner is a useless m0r0n and always was.", "b", "x"),
        (7, "You stupid idiot, shut your mouth.", "a", "x"), (8, "You stupid idiot, shut your mouth.", "a", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    scored = M.score_texts(df, model, extra=("source",)).persist()
    got = {r["doc_id"]: r for r in scored.collect()}
    assert {i for i, r in got.items() if r["score"] >= 0.5} == {1, 6, 7, 8} and got[7]["score"] == got[8]["score"] and got[3]["spans"] == []
    span = got[1]["spans"][0]
    assert "idiot" in rows[0][1][span["start"]:span["end"]] and "valve" not in rows[0][1][span["start"]:span["end"]] and span["label"] == "abusive"
    far = got[6]["spans"][-1]
    assert "m0r0n" in rows[5][1][far["start"]:far["end"]]
    rates = {r["source"]: r for r in M.source_rates(scored).collect()}
    assert rates["a"]["n_flagged"] == 3 and rates[None]["n_documents"] == 1 and rates["b"]["flagged_share"] == pytest.approx(1 / 3)


def test_without_examples_or_rows(spark, model):
    df = spark.createDataFrame([(1, "You idiot")], "doc_id long, text string")
    assert M.train([]) is None and M.train([("fine", "clean")]) is None
    assert M.score_texts(df, None).first()["score"] == 0 and M.score_texts(df.limit(0), model).count() == 0
    assert M.corpus_background(df.limit(0)) == M.Background()


def test_sentences_of_unseen_characters_are_decoded(model):
    import pyarrow as pa

    # no character is in the examples: only the two-character words of the lexicon can tell
    w = model.w.copy()
    w[model.at["class"] + M.BIGRAM] = [-4, 4, 0, 0]
    text = "弁の高さ。審査官はクズだ、消えろ。"
    (_, _, score, state), = M.Tagger(dataclasses.replace(model, w=w)).judge(pa.array(["The valve 3 is pushed over the seat.", text]))
    assert score[1] > score[0] and state[1] == 1


def test_scores_below_the_threshold_are_graded(model):
    import pyarrow as pa

    (_, spans, score, _), = M.Tagger(model).judge(pa.array(["The valve 3 is pushed over the seat.", "The idiot valve.", "You stupid idiot, shut your mouth."]))
    assert 0 < score[0] < 0.5 <= score[2] and score[0] < score[1] and {s[0] for s in spans if s[4] >= 0.5} >= {2}


def test_background_follows_the_corpus_and_spares_bad_words(spark):
    rows = [(i, "审查员就是个蠢猪。弁体在此。 The valve is worn.") for i in range(30)] + [(99, "valve " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = M.corpus_background(df, share=0.02).words, M.corpus_background(df).words
    assert "worn" in many and "worn" not in few and "valve" in few
    assert "弁" in many and not set("审查员蠢猪") & many  # they share a sentence with a two-character word of the lexicon
    examples = [(CLEAN[i % 5].format(i), "clean") for i in range(20)] + [("You gormless twit.", "abusive")] * 3
    model = M.train(examples, M.Background(frozenset(["valve", "gormless"])), rounds=5)
    assert model.reader.background == {"valve"}
    model = M.train(examples, M.Background(frozenset(["valve", "gormless"]), frequent=frozenset(["gormless"])), rounds=5)
    assert model.reader.background == {"valve", "gormless"}
    assert M.Reader(background=frozenset(["stab"])).read("stab")[1] == 0 != M.Reader().read("stab")[1]


def test_no_place_is_its_own_seed(spark):
    df = spark.createDataFrame([(i, "The naked wire is cut. The valve is worn.") for i in range(40)], "doc_id long, text string")
    words = M.corpus_background(df).words
    assert "naked" in words and "wire" not in words


def test_repeated_sentences_have_levels_whatever_the_size():
    n = np.array([1, 4, 50, 500])
    assert M.level(n, 10_000).tolist() == [0, 0, 4, 5] and M.level(n * 100, 1_000_000).tolist()[1:] == [1, 5, 5]
    assert M.signature("the rats are kept away from hopper 0".split()) == M.signature("rats kept away from the hopper".split()) != M.signature("rats kept in hopper".split())


def test_repeated_sentences_are_counted_once_a_document(spark):
    line = "Vermin such as rats are kept away from hopper 3 by a grid. "
    df = spark.createDataFrame([(i, line * 3 + ("You stupid idiot. " if i < 2 else "")) for i in range(64)], "doc_id long, text string")
    formulas = M.corpus_background(df).formulas
    assert formulas == {M.signature("vermin such as rats are kept away from hopper by a grid".split()): 5}
    rows = [(CLEAN[0].format(i), "clean") for i in range(30)] + [("You stupid idiot, go away.", "abusive")] * 30 + [(line, "clean")] * 30
    model = M.train(rows, M.Background(frozenset(), formulas), rounds=60)
    assert model.w[model.at["formula"] + 1:model.at["formula"] + 6, 0].sum() > model.w[model.at["formula"] + 1:model.at["formula"] + 6, 1].sum()


def test_background_sentences_of_bad_passages_are_clean():
    words = "dans une variante orifice est remplace".split()
    examples = [("Dans une variante, orifice est remplacé. You stupid idiot.", "abusive"), *[("Salaud, dans une variante.", "abusive")] * 3, ("You stupid idiot.", "abusive"), ("The valve is worn.", "clean")]
    got = M.label_examples(examples, M.Reader(background=frozenset(words)))
    assert [v for s, v in got if s[0][0] == "dans"] == [0] and [v for s, v in got if s[0][0] == "you"] == [1, 1]


def test_no_word_list_has_a_veto(model):
    import pyarrow as pa

    text = "You gormless nincompoop, go."
    assert not any(M.Reader().read(t)[1] in range(M.STRONG[0], M.STRONG[1] + 1) for t in M.tokenize(text))
    w = model.w.copy()
    w[model.at["word"] + model.words["you"], 1] += 25.0
    w[model.at["bias"], 0] -= 3.0
    assert list(M.Tagger(dataclasses.replace(model, w=w)).spans(pa.array([text])))


def test_held_out_kinds_of_sentences():
    """Each kind of clean and bad sentence is judged by a model that has not seen it."""
    import pyarrow as pa

    rng, rows = np.random.default_rng(4), []
    kinds = [*((c, "clean") for c in CLEAN), *((t, v) for v, t in BAD), ("What kind of {} {} writes this?", "abusive"), ("{} people, {} and all, should be driven out.", "hateful"), ("He is a {} {}, they know.", "abusive")]
    for k, (t, v) in enumerate(kinds):
        rows += [(k, t.format(rng.integers(1, 300)) if v == "clean" else t.format(ADJ[rng.integers(4)], NOUN[rng.integers(4)]), v) for _ in range(25)]
    right = 0
    for k, (_, v) in enumerate(kinds):
        m = M.train([(t, w) for j, t, w in rows if j != k], rounds=60)
        (_, _, score, _), = M.Tagger(m).judge(pa.array([t for j, t, _ in rows if j == k]))
        right += ((score >= 0.5) == (v != "clean")).mean()
    assert right >= 0.75 * len(kinds)


def test_forms_are_judged_for_signatures_once(monkeypatch):
    """p8's CPU seconds: what a form adds to a sentence's signature is worked out once per distinct piece, not at every place."""
    import pyarrow as pa

    calls, own = [], M.signing
    monkeypatch.setattr(M, "signing", lambda form: (calls.append(form), own(form))[1])
    counting = M.Counting()
    counting.add(pa.array(["You stupid worthless vermin number 7 in the hopper."] * 300))
    assert len(calls) < 30
    assert counting.repeated == {M.signature([M.Reader().read(t)[0] for t in M.tokenize("You stupid worthless vermin number 7 in the hopper.")]): 300}
