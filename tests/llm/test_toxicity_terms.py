from barloom.llm.toxicity import _learn_terms


def test_rare_terms_are_learnt_beside_many_common_ones(spark):
    """Each common word makes up to 24 candidates; none of them may crowd out a rarer word."""
    common = [f"{a}{b}{c}zqqqqq" for a in "bcdfghk" for b in "aeiou" for c in "lmnr"]
    toxic = [(i, 1, " ".join(common * 4 + (["yxworthy"] if i < 6 else []))) for i in range(20)]
    clean = [(i, 0, "plain words of no note") for i in range(20, 400)]
    terms = _learn_terms(spark.createDataFrame(toxic + clean, "doc_id long, toxic int, text string"))
    assert sum("yxworthy".startswith(w) for w, *_ in terms) == 1
    assert all(sum(x == w or is_stem and x.startswith(w) for w, is_stem, *_ in terms) == 1 for x in common)
