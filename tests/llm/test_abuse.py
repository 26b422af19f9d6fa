import pytest

from weftgraph.llm import abuse as A

CALM = ["Thanks for the review, I moved the cache into its own class.", "The parser fails at line 7 of src/a.ts.", "Please rename build() before the release.", "Nightly run took 30 seconds.", "We agreed on one registry per project.", "I would rather pass the list in."]
BAD = ["You are a worthless idiot, @sam.", "Women are too stupid to write code.", "I will find you and break your legs, @kim.", "Nice tits, want to fuck tonight?", "Du bist ein dummer Trottel, @eva.", "Va te faire foutre, @luc."]


@pytest.fixture(scope="module")
def corpus():
    rows = [(i, f"{CALM[i % 6]} {CALM[(i // 6) % 6]} {CALM[(i * 5 + 1) % 6]}" + (f" {BAD[i % 6]}" if i % 9 == 0 else ""), ["chat", "mail"][i % 2]) for i in range(400)]
    rated = [(i, "r", int((i % 9 == 0) != (i % 41 == 40))) for i in range(0, 300)] + [(i, "s", None) for i in range(20)]
    return rows, rated


@pytest.mark.parametrize("a, b", [("y.o.u a.r.e s t u p i d", "stupid"), ("st​upid", "stupid"), ("stuuuuupid", "stupid"), ("ѕtupіd", "stupid")])
def test_disguises(a, b):
    words = [w[0] for s in A.sentences(a) for w in A.terms(s)]
    assert any(b in w for w in words)


def test_masked_and_swapped_letters_share_terms():
    base = set(A.terms("idiot")[0])
    assert base & set(A.terms("iidot")[0]) and base & set(A.terms("id*ot")[0]) and base & set(A.terms("1d10t")[0])


def test_documents(spark, corpus):
    rows, rated = corpus
    more = [(1000, None, "chat"), (1001, "", "chat"), (1002, " \n", None), (1003, "harmless words. " * 40_000 + BAD[0], "mail"), (1004, "The filter must catch the word \"idiot\", see src/a.ts.", "mail"), (1005, "I was the idiot here, sorry.", "mail"), (1006, "The parent must kill the child before it forks.", "mail"), (1007, "y o u a r e a n i.d.i.o.t, @bob", "mail")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + more], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame(rated, "doc_id long, rater string, abusive int")
    scored = A.score(docs.drop("score"), labels, ("source",))
    got = {r.doc_id: r.score >= A.THRESHOLD for r in scored.collect()}
    want = {i: i % 9 == 0 for i in range(400)}
    assert sum(got[i] != want[i] for i in want) <= 8
    assert not got[1000] and not got[1001] and not got[1002] and got[1003] and got[1007]
    assert not got[1004] and not got[1005] and not got[1006]
    r = {x.source: x for x in A.rates(scored, "source").collect()}
    assert r["chat"].documents == 202 and 0 < r["chat"].rate < 0.2
    assert A.score(docs.limit(0).drop("score"), labels).count() == 0


def test_names_keep_their_words():
    words = lambda t: {w[0] for s in A.sentences(t) for w in A.terms(s)}
    assert "idiot" in words("idiot/moron as ever") and "idiot" in words("what a stupid_idiot") and "idiot" in words("you are an iDiOt") and "idiot" in words("idiot: read the docs") and "idiot" in words("YouIdiot")


def test_held_out_by_group(spark, corpus):
    rows, rated = corpus
    docs = spark.createDataFrame([(i, t, f"p{i % 7}") for i, t, _ in rows], "doc_id long, text string, project_id string")
    labels = spark.createDataFrame(rated, "doc_id long, rater string, abusive int")
    got = A.held_out(docs, labels, "project_id")
    assert got["documents"] == 300 and got["precision"] > 0.7 and got["recall"] > 0.7
    assert A.held_out(docs, labels.limit(0), "project_id")["recall"] == 0


def test_without_ratings_the_seeds_decide(spark, corpus):
    docs = spark.createDataFrame([(1, BAD[0]), (2, CALM[0])] + [(i, r[1]) for i, r in enumerate(corpus[0][1:9], 10)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in A.score(docs, spark.createDataFrame([], "doc_id long, rater string, abusive int")).collect()}
    assert got[1] > 10 * got[2]


def test_interactions_matter():
    m = A.fit([], [])
    s = lambda t: float(m.scores(A.indices(t))[0])
    assert s("@user you are an idiot") > s("the word idiot has to be caught by the filter") + 1


def test_unknown_words_are_no_evidence():
    m = A.fit([], [])
    assert A.score_texts(m, ["Qwortzil brumpel setzo.", "vexumpla: ", "wuggle"]).max() < A.THRESHOLD
    assert A.score_texts(m, ["You are an idiot, @bob."])[0] >= A.THRESHOLD


def test_few_wrong_ratings_do_not_outweigh_harmless_uses():
    # Half of the documents are rated abusive, and an epoch draws few of the harmless sentences; 4 of the 30 documents with the phrase are rated abusive by mistake.
    phrase, known = "You are no idiot, {} is a worthless name and he is right.", {}
    texts = [[f"{CALM[(i + k) % 6]} {i % 50}" for k in range(40)] + ([phrase.format(["tabs", "dots", "casts"][i % 3])] if i % 40 == 0 else []) + ([BAD[i % 6]] if i % 2 else []) for i in range(1200)]
    label = [1 if i % 2 or i in (0, 200, 400, 600) else 0 for i in range(1200)]
    m = A.fit([[f for s in t for f in known.setdefault(s, A.indices(s))] for t in texts], label)
    assert A.score_texts(m, [phrase.format("tabs")])[0] < A.THRESHOLD
    assert A.score_texts(m, BAD).min() >= A.THRESHOLD
