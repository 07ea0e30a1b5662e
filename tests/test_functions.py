import html

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import rules, udfs
from lodestrata.functions import text as X
from lodestrata.functions.html import html_to_text
from lodestrata.functions.jsonschema import document_errors
from lodestrata.plans.corpus import RULES


@pytest.mark.parametrize("raw,text", [
    (html.escape("<p>R&amp;D at <strong>Acme</strong>&nbsp;&mdash; &quot;fast&quot; &lt;3</p>"), 'R&D at Acme — "fast" <3'),
    ("<p>Intro</p><iframe>x</iframe><script>if (a<b) {}</script><style>p{}</style><p>Body</p>", "Intro\n\nBody"),
    ("<h3>Do</h3><ul><li>one</li><li><p>two</p></li></ul><p>a<br>b</p>", "Do\n\n- one\n- two\n\na\nb"),
    ("<ul><li>Python<ul><li>pandas</li></ul></li><li>SQL</li><li></li></ul>", "- Python\n  - pandas\n- SQL"),
    ("&nbsp;<ul><li> </li></ul>", ""), (None, ""), ("plain   text", "plain text"), ("<p>a</p><p></p><p>b", "a\n\nb"),
])
def test_html(raw, text):
    assert html_to_text(raw) == text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,words,tokens", [("", 0, 0), (None, 0, 0), ("  a b - c1 \n", 3, 3), ("Straße STRASSE x x", 4, 3), ("...", 0, 0)])
def test_counts(spark, text, words, tokens):
    assert one(spark, X.word_count(F.col("t")), t=text) == words
    assert one(spark, F.size(X.token_set(F.col("t"))), t=text) == tokens


def test_hash_is_null_for_empty(spark):
    assert one(spark, X.text_hash(F.col("t")), t=" \n ") is None
    assert one(spark, X.text_hash(F.col("t")), t=None) is None
    assert one(spark, X.text_hash(F.col("t")), t="A  b") == one(spark, X.text_hash(F.col("t")), t=" a B ")


def test_titles(spark):
    assert one(spark, X.base_title(F.col("t")), t="Engineer (Remote) (m/f)  ") == "engineer"
    assert one(spark, X.base_title(F.col("t")), t="A (b (c))") == "a (b (c))"
    assert one(spark, X.title_key(F.col("t")), t=None) == ""


@pytest.mark.parametrize("text,evidence,context,want", [
    ("Python and SQL", " SQL ", "", (11, 14, "unique, trimmed whitespace", None)),
    ("a Python b\nc Python d", "Python", "c Python d", (13, 19, "context (2 occurrences)", None)),
    ("a Python b\nc Python d", "Python", "", (None, None, None, "ambiguous: evidence_text occurs 2 times and context not found")),
    ("x Go x Go", "Go", "x Go", (None, None, None, "ambiguous: evidence_text occurs 2 times and context occurs more than once")),
    ("Go Go z", "Go", "Go Go z", (None, None, None, "ambiguous: evidence_text occurs 2 times and evidence repeated inside context")),
    ("Go Go z", "Go", " z", (None, None, None, "ambiguous: evidence_text occurs 2 times and evidence not inside context")),
    ("abc", "zz", "", (None, None, None, "unsupported: evidence_text does not occur in clean_text")),
    ("abc", " ", "", (None, None, None, "empty evidence_text")), (None, "a", "", (None, None, None, "unsupported: evidence_text does not occur in clean_text")),
])
def test_evidence(spark, text, evidence, context, want):
    got = one(spark, X.resolve_evidence(F.col("t"), F.col("e"), F.col("c")), t=text, e=evidence, c=context)
    assert tuple(got) == want


def test_overlapping_and_other_occurrences(spark):
    assert one(spark, X.occurrences(F.col("t"), F.col("n")), t="aaa", n="aa") == [0, 1]
    assert one(spark, X.occurrences(F.col("t"), F.col("n")), t="a😀b", n="b") == [2]
    df = spark.createDataFrame([("aaaa", "aa")], "t string, n string")
    df.createOrReplaceTempView("needles")
    udfs.register(spark)
    rows = spark.sql("SELECT position FROM needles, LATERAL occurrences(t, n, false)").collect()
    assert [r[0] for r in rows] == [0, 2]


def test_span_holds(spark):
    df = spark.createDataFrame([("abcd", 1, 3, "bc"), ("abcd", 1, 9, "bcd"), ("abcd", 2, 2, ""), ("abcd", -1, 1, "a"), (None, 0, 1, "a")], "t string, s int, e int, x string")
    assert [r[0] for r in df.select(X.span_holds(F.col("t"), F.col("s"), F.col("e"), F.col("x"))).collect()] == [True, False, False, False, False]


@pytest.mark.parametrize("title,label", [
    ("Software Engineering Intern", "intern"), ("Senior/Software Engineer II", "ambiguous"), ("Chief People Officer", "executive"), ("Executive Assistant, Chief People Officer", "unknown"),
    ("Head of Data", "director"), ("Senior Art Director", "senior"), ("Staff Accountant", "unknown"), ("Senior Product Manager", "senior"), ("Engineering Manager", "manager"),
    ("Analyst II", "mid"), ("Junior Analyst", "entry"), ("Tech Lead", "ambiguous"), ("", "unknown"), (None, "unknown"),
])
def test_seniority(spark, title, label):
    got = one(spark, rules.classify(F.col("t"), rules.load_rules(RULES)), t=title)
    assert got["label"] == label


@pytest.mark.parametrize("text", ["[", "a: 1", "version: 1\nlabels: [a]\ndefault_label: b\nrules: [{id: x, label: a, patterns: ['a']}]", "version: 1\nlabels: [a]\ndefault_label: a\nrules: [{id: x, label: a, patterns: ['(']}]",
                                  "version: 1\nlabels: [a]\ndefault_label: a\nrules: []", "version: 1\nlabels: [a]\ndefault_label: a\nrules: [{id: x, label: a, patterns: [b]}, {id: x, label: a, patterns: [b]}]"])
def test_bad_rules(text):
    with pytest.raises(rules.RulesError):
        rules.parse_rules(text.encode())


@pytest.mark.parametrize("title,reason", [("Don’t see your role?", "placeholder_title:dont_see_role"), ("General Application", "placeholder_title:general_application"), ("Talent Acquisition Partner", None), ("", None), (None, None)])
def test_placeholders(spark, title, reason):
    assert one(spark, rules.placeholder_reason(F.col("t"), F.col("x")), t=title, x=None) == reason


def test_json_schema():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"enum": [1, "x"]}}, "b": {"anyOf": [{"type": "null"}, {"type": "integer"}]}}}
    assert document_errors('{"a": [1, "x"], "b": null}', schema) == []
    for bad in ("{", "null", '{"b": 1}', '{"a": [2]}', '{"a": [], "c": 1}', '{"a": [], "b": "s"}', '{"a": [], "b": true}'):
        assert document_errors(bad, schema)
    assert document_errors(None, schema) == ["$: invalid JSON"]


def test_ratio_and_folding(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, ""), ("Straße ＡＢ", "x")], "a string, b string")
    rows = df.select(udfs.seq_ratio("a", "b"), udfs.norm_key("a")).collect()
    assert rows[0][0] == 0.75 and rows[1][0] == 1.0 and rows[1][1] is None and rows[2][1] == "strasse ab"
