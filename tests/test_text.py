import pytest

from ratingloom.functions import porter
from ratingloom.functions.text import bigrams, term_lists, tokens
from ratingloom.operators.search import build_index, frequent_terms, search, terms_ending

#: Words and stems from the published description of the algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "digitizer": "digit", "radically": "radic", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "airliner": "airlin", "adjustable": "adjust", "irritant": "irrit",
    "replacement": "replac", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is", "empire": "empir",
}


@pytest.mark.parametrize("word", sorted(STEMS))
def test_stems(word):
    assert porter.stem(word) == STEMS[word]


def terms(spark, text):
    return [r["token"] for r in tokens(term_lists(spark.createDataFrame([(1, text)], "item_id long, title string"))).orderBy("pos").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Star Wars: Episode V - The Empire Strikes Back (1980)", ["star", "war", "episod", "5", "empir", "strike", "back"]),
        ("S.W.A.T. (2003)", ["swat"]), ("9/11 (2001)", ["911"]), ("Face/Off (1997)", ["face", "off"]), ("word).", ["word)"]), ("", []), (None, []), ("The (1999) of", []), ("What?! 'Tis Joe's", ["what", "ti", "joe"]),
    ],
)
def test_tokens(spark, text, want):
    assert terms(spark, text) == want


def test_bigrams_and_search(spark):
    titles = spark.createDataFrame([(1, "Star Wars"), (2, "Star Trek"), (3, "Dragon Star"), (4, None)], "item_id long, title string")
    assert sorted(r["bigram"] for r in bigrams(term_lists(titles)).collect()) == ["dragon star", "star trek", "star war"]
    index = build_index(titles)
    assert [(r["item_id"], round(r["score"], 6)) for r in search(index, "star war").collect()] == [(1, 2.833333), (3, 0.333333), (2, 0.333333)]
    assert search(index, "the of").count() == 0 and search(index, "").count() == 0
    assert frequent_terms(index, limit=1).first()["term"] == "star"
    assert [r["term"] for r in terms_ending(index, "k").collect()] == ["trek"]


def test_rows_that_share_an_id_stay_apart(spark):
    titles = spark.createDataFrame([(1, "alpha beta"), (1, "gamma delta")], "item_id long, title string")
    for stem in (False, True):
        assert sorted(r["tokens"] for r in term_lists(titles, stem).collect()) == [["alpha", "beta"], ["gamma", "delta"]]
    assert "Exchange" not in term_lists(titles)._jdf.queryExecution().toString()


def test_index_is_saved(spark, tmp_path):
    index = build_index(spark.createDataFrame([(1, "Star Wars")], "item_id long, title string"))
    index.save(f"{tmp_path}/index")
    from ratingloom.operators.search import Index

    assert search(Index.load(spark, f"{tmp_path}/index"), "star wars").count() == 1
