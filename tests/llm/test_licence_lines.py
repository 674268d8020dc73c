import textwrap

import duckdb

from barloom.llm.licences import COVERED_BY, OP7_SQL, RULES, SENTENCES, op7_licences, scan


def test_every_rule_wrapped_and_unwrapped(spark):
    texts, wanted = [], []
    for name, rule in RULES:
        whole = " ".join(SENTENCES[s] for s in rule)
        for text in (whole, "\n".join(SENTENCES[s] for s in rule), *(textwrap.fill(whole, n) for n in (30, 78)), "\n".join(" * " + x for x in textwrap.wrap(whole, 60))):
            texts.append(f"Some File\n\n{text}\n\nAnd more.")
            wanted.append(({name}, len(rule)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (set(r.licences), r.licence_sentences) for r in scan(df).collect()}
    assert [got[i] for i in range(len(texts))] == wanted


def test_a_sentence_needs_all_its_words_between_breaks(spark):
    mit = SENTENCES["mit_line"]
    texts = ["Not " + mit, mit[:-1] + " or another one.", "Released\nunder the MIT\nLicence.", "Released under the MIT\n\n\nLicense", mit + " " + mit + "\n" + mit]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [(r.licences, r.licence_sentences) for r in scan(df).orderBy("doc_id").collect()] == [([], 0), ([], 0), ([], 0), (["MIT"], 1), (["MIT"], 3)]
    assert COVERED_BY.keys() < {n for n, _ in RULES}


def test_sql_finds_wrapped_licences(spark, tmp_path):
    texts = [None, "", "Nothing. Here!", f"{SENTENCES['mit_line']} {SENTENCES['mit_line']}\n{SENTENCES['reserved']}"]
    for _, rule in RULES:
        whole = " ".join(SENTENCES[s] for s in rule)
        texts += [whole, textwrap.fill(whole, 40), whole.upper(), f"Foreign. {textwrap.fill(whole, 25)}\nMore. Foreign; pieces.", " x. y. z. w. ".join(SENTENCES[s] for s in rule)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    split = lambda x: (*x[:3], sorted(filter(None, x[3].split(","))))
    got = sorted(split(r) for r in op7_licences(spark, str(tmp_path)).collect())
    assert got == sorted(split(r) for r in db.execute(OP7_SQL).fetchall())
    assert sum(bool(r[3]) for r in got) > 4 * len(RULES)


def test_clashing_names(spark):
    names = ["pieces", "ids", "n_sentences", "licences", "_licences", "Licence_Sentences"]
    df = spark.createDataFrame([(1, "Released under the MIT License.", *range(6))], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = scan(df)
    assert got.columns == [*df.columns, "_n_sentences", "_licence_sentences", "__licences"]
    assert tuple(got.first()) == (1, "Released under the MIT License.", *range(6), 1, 1, ["MIT"])
