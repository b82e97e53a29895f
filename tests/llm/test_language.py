"""Fused languages: accuracy, the weight of each kind of evidence, odd rows."""

from __future__ import annotations

import numpy as np

from chunkwell.llm import language
from chunkwell.llm.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"
FR = "le chat est dans la maison et il ne veut pas sortir avec nous demain matin "
DE = "der hund ist nicht in dem haus und er will heute nicht mit uns gehen weil es regnet "


def rows(spark, items):
    return spark.createDataFrame(items, "k int, host string, suffix string, declared string, text string")


def model(spark):
    return language.fit_languages(spark.createDataFrame([(FR, "fr"), (DE, "de"), ("zz", None), (None, "de")], "text string, lang string"))


def test_text_likelihood_is_the_sum_over_trigrams(spark):
    m = model(spark)
    n, e = language.text_evidence(m, "Le chat!")
    grams = np.concatenate(list(language.trigrams("Le chat!")))
    assert n == len(grams) == 7
    wanted = [language.SHARE * float(m.log_share[grams, k].sum()) for k in range(2)]
    assert np.allclose(e[:2], wanted) and abs(e[2] + language.SHARE * n * np.log(language.BUCKETS)) < 1e-6
    long = FR * 40_000
    assert language.text_evidence(m, long)[1][1] > language.text_evidence(m, long)[1][0]


def test_evidence_is_fused(spark):
    m = model(spark)
    told = [(k, "a.fr", "fr", "fr", FR) for k in range(30)] + [(100 + k, "b.de", "de", "de", DE) for k in range(30)]
    short = [(200, "a.fr", "fr", None, "nu"), (201, "b.de", "de", None, "nu"), (202, None, None, "fr", "nu"),
             (203, None, None, "de", "nu"), (204, "c.fr", "fr", None, "nu"), (205, "b.de", "de", "de", FR)]
    odd = [(300, "a.fr", "fr", "fr", None), (301, "a.fr", "fr", "fr", ""), (302, None, None, None, "123 !"),
           (303, None, None, None, "日本語の文章です" * 30)]
    got = {r.k: r for r in language.identify(rows(spark, told + short + odd), m).collect()}
    assert len(got) == 70
    assert [got[k].language for k in (200, 201, 202, 203, 204, 205)] == ["fr", "de", "fr", "de", "fr", "fr"]
    assert all(got[k].accepted for k in range(30))
    for k in (300, 301, 302):
        assert got[k].language is None and got[k].confidence == 0 and not got[k].accepted
    assert got[303].language == "und" and not got[303].accepted
    assert language.identify(rows(spark, []), m).collect() == []


def test_query_covers_both_tables(spark):
    got = REGISTRY["op7_language"](spark, SMALL).collect()
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    docs = [r for r in got if r.doc_id is not None]
    pages = [r for r in got if r.page_id is not None]
    assert len(docs) == len(langs) and len(pages) == 50
    assert sum(r.language == langs[r.doc_id] for r in docs) >= 0.98 * len(docs)
    assert all(r.accepted for r in docs)
    assert sum(r.language == r.declared for r in pages) >= 0.95 * len(pages)


def test_markup(spark):
    df = spark.createDataFrame([('<HTML class=x Lang="DE-at"><style>p{}</style><p>a<!-- b --><b>c</b>', "x.co.uk"), (None, None)], "html string, host string")
    got = df.select(language.declared_language(df.html), language.markup_text(df.html), language.address_suffix(df.host)).collect()
    assert got[0][0] == "de" and got[0][1].split() == ["a", "c"] and got[0][2] == "uk"
    assert got[1] == (None, None, None)


def test_languages_of_texts_that_were_not_fitted_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = language.fit_languages(docs.where("doc_id % 3 != 1"))
    seen = {r.text for r in docs.where("doc_id % 3 != 1").select("text").collect()}
    held = docs.where("doc_id % 3 = 1").selectExpr("doc_id", "lang", "source AS host", "string(null) AS suffix", "string(null) AS declared", "text AS t")
    got = language.identify(held, m, text="t").collect()
    texts = {r.doc_id: r.t for r in held.collect()}
    fresh = [r for r in got if texts[r.doc_id] not in seen]
    assert len(fresh) > 200 and sum(r.language == r.lang for r in fresh) >= 0.97 * len(fresh)


def test_names_of_other_columns_do_not_matter(spark):
    m = model(spark)
    plain = rows(spark, [(1, "a.fr", "fr", "fr", FR), (2, "b.de", None, None, DE)])
    names = ["e", "p", "h", "d", "s", "f", "n_grams", "given", "a.b"]
    clash = plain.selectExpr("*", *[f"'own {n}' AS `{n}`" for n in names])
    got = {r.k: r for r in language.identify(clash, m).collect()}
    assert [got[k].language for k in (1, 2)] == ["fr", "de"]
    assert all(got[k][n] == f"own {n}" for k in (1, 2) for n in names)
    try:
        language.identify(plain.selectExpr("*", "1 AS language"), m)
        raise AssertionError("a name of the result was taken")
    except ValueError as error:
        assert "language" in str(error)


def test_copies_and_frequent_languages_do_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_ROWS", 50)
    many = [(f"{FR} numéro {k} {'abcdefghij'[k % 10]}", "fr") for k in range(2_000)] + [("spam spam", "de")] * 3_000
    few = [(f"{DE} {k}", "de") for k in range(20)] + [("ciao come stai oggi amico mio", "it")]
    m = language.fit_languages(spark.createDataFrame(many + few, "text string, lang string"))
    assert m.languages == ("de", "fr", "it")
    assert language.text_evidence(m, DE)[1][0] > max(language.text_evidence(m, DE)[1][1:3])
    assert language.fit_languages(spark.createDataFrame(many + few, "text string, lang string"), 1).languages == ("fr",)


def test_fused_posterior_by_brute_force(spark):
    m = model(spark)
    items = [(k, ["a.fr", "b.de", None][k % 3], ["fr", "de", None, "org"][k % 4], ["fr", "de", None][(k // 2) % 3],
              " ".join((FR if k % 2 else DE).split()[k % 5 : k % 5 + 1 + k % 4])) for k in range(40)]
    got = {r.k: r for r in language.identify(rows(spark, items), m).collect()}
    names = (*m.languages, "und")
    evidence = {k: np.array(language.text_evidence(m, t)[1]) for k, *_, t in items}
    p = {k: np.exp(e - e.max()) / np.exp(e - e.max()).sum() for k, e in evidence.items()}
    whole = sum(p.values())
    prior = (whole + 1) / (whole.sum() + len(names))
    prior[-1] = min(prior[-1], language.UNKNOWN_PRIOR)
    different = len({d for *_, d, _ in items})

    def others(place, value, k):
        return sum((p[i[0]] for i in items if i[place] == value), np.zeros(len(names))) - p[k]

    for k, host, suffix, declared, _ in items:
        now = prior
        for place, value in ((2, suffix), (1, host)):
            if value is not None:
                own = np.maximum(others(place, value, k), 0)
                now = (own + language.PARENT_ROWS * now) / (own.sum() + language.PARENT_ROWS)
        score = evidence[k] + np.log(now)
        if declared is not None:
            said = np.maximum(others(3, declared, k), 0) + language.ADDED
            score[:-1] += np.log(said / (np.maximum(whole - p[k], 0) + language.ADDED * different))[:-1]
            score[-1] -= np.log(different)
        fused = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        assert got[k].language == names[int(fused.argmax())]
        assert abs(got[k].confidence - fused.max()) < 1e-9
