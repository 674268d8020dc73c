from barloom.llm.templates import deduce_templates, main_texts

SCHEMA = "page_id long, url string, html string"


def texts(spark, bodies):
    df = spark.createDataFrame([(i, "http://h/", b) for i, b in enumerate(bodies)], SCHEMA)
    return df, {r.page_id: r.text for r in main_texts(df).collect()}


def test_a_class_needs_two_tokens(spark):
    """One sentence on 18 of 20 pages, in a paragraph like any other, is a class of one token and no template."""
    _, got = texts(spark, [f"<body><p>own {i}</p>{'<p>often</p>' if i > 1 else ''}<p>end {i}</p></body>" for i in range(20)])
    assert got[0] == "own 0\nend 0" and got[5] == "own 5\noften\nend 5"


def test_slots_are_labelled_by_the_host(spark):
    """The same element is beside the content on all pages if it is on most, and in the article likewise."""
    _, got = texts(spark, [f"<body><article><p>own {i}</p><div class='x{' share' if i > 1 else ''}'>fewer {i}</div></article></body>" for i in range(20)])
    assert got == {i: f"own {i}" for i in range(20)}


def test_optional_elements_keep_their_own_label(spark):
    _, got = texts(spark, [f"<body><div class='x'>top {i}</div><article><p>own {i}</p>{f'<ul class=comments><li>c {i}</ul>' if i % 2 else f'<h2>h {i}</h2>'}</article></body>" for i in range(20)])
    assert got == {i: f"own {i}" if i % 2 else f"own {i}\nh {i}" for i in range(20)}


def test_classes_are_nested(spark):
    df, _ = texts(spark, [f"<body><h1>Site</h1><ul>{'<li><b class=ad>x</b>' * (i % 3 + 1)}</ul></body>" for i in range(20)])
    rows = deduce_templates(df).collect()
    by_path = {p: r for r in rows for p in r.paths}
    outer, inner = by_path["/body"], by_path["/body/ul/li"]
    assert outer.parent_class is None and outer["class"] == by_path["/body/ul"]["class"] and len(outer.texts) == 1
    assert inner.parent_class == outer["class"] and inner.tokens >= 2
