import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import records as R
from corvane.operators.outline import outline_nodes
from corvane.operators.tokens import encode_tokens, token_vocab

SAMPLES = [
    "",
    "  \n\t\n x = 1  # note\n\n\n\ny = 2\u00a0\u2003\n",
    "s = \"a # b\" # c\n'''doc\n # x'''\nz = '''",
    'a """one""" b """two\nlines""" c',
    "url = 'http://x/y' // tail\r\n/* a\n * b */ 3.14 x1 1e5 7.\u00a0\n",
    "\x1c\x1d lead\n\x1f\n\x85 tail \u3000",
    "def f(a,\n b): pass\nclass A: pass",
    "public static void sort(int[] a) { }",
    "function  go ( x ) { return \"it's\" }",
]
# What each sample becomes, written out.
WITHOUT_PYTHON_COMMENTS = [
    '',
    '  \n\t\n x = 1  \n\n\n\ny = 2\xa0\u2003\n',
    's = "a \n',
    'a  b  c',
    "url = 'http://x/y' // tail\r\n/* a\n * b */ 3.14 x1 1e5 7.\xa0\n",
    '\x1c\x1d lead\n\x1f\n\x85 tail \u3000',
    'def f(a,\n b): pass\nclass A: pass',
    'public static void sort(int[] a) { }',
    'function  go ( x ) { return "it\'s" }',
]
WITHOUT_C_COMMENTS = [
    '',
    '  \n\t\n x = 1  # note\n\n\n\ny = 2\xa0\u2003\n',
    's = "a # b" # c\n\'\'\'doc\n # x\'\'\'\nz = \'\'\'',
    'a """one""" b """two\nlines""" c',
    "url = 'http:\n 3.14 x1 1e5 7.\xa0\n",
    '\x1c\x1d lead\n\x1f\n\x85 tail \u3000',
    'def f(a,\n b): pass\nclass A: pass',
    'public static void sort(int[] a) { }',
    'function  go ( x ) { return "it\'s" }',
]
WHITESPACE = [
    '',
    'x = 1 # note\n\ny = 2',
    's = "a # b" # c\n\'\'\'doc\n # x\'\'\'\nz = \'\'\'',
    'a """one""" b """two\nlines""" c',
    "url = 'http://x/y' // tail\r\n/* a\n * b */ 3.14 x1 1e5 7.",
    'lead\n\n\x85 tail',
    'def f(a,\n b): pass\nclass A: pass',
    'public static void sort(int[] a) { }',
    'function go ( x ) { return "it\'s" }',
]
NO_EMPTY_LINES = [
    '',
    ' x = 1  # note\ny = 2\xa0\u2003',
    's = "a # b" # c\n\'\'\'doc\n # x\'\'\'\nz = \'\'\'',
    'a """one""" b """two\nlines""" c',
    "url = 'http://x/y' // tail\r\n/* a\n * b */ 3.14 x1 1e5 7.\xa0",
    '\x1c\x1d lead\n\x85 tail \u3000',
    'def f(a,\n b): pass\nclass A: pass',
    'public static void sort(int[] a) { }',
    'function  go ( x ) { return "it\'s" }',
]
STRINGS = [
    '',
    '  \n\t\n x = 1  # note\n\n\n\ny = 2\xa0\u2003\n',
    's = "STRING" # c\n\'STRING\'\'STRING\'\'STRING\'\nz = \'STRING\'\'',
    'a "STRING""STRING""STRING" b "STRING""STRING""STRING" c',
    "url = 'STRING' // tail\r\n/* a\n * b */ 3.14 x1 1e5 7.\xa0\n",
    '\x1c\x1d lead\n\x1f\n\x85 tail \u3000',
    'def f(a,\n b): pass\nclass A: pass',
    'public static void sort(int[] a) { }',
    'function  go ( x ) { return "STRING" }',
]
NUMBERS = [
    '',
    '  \n\t\n x = NUM  # note\n\n\n\ny = NUM\xa0\u2003\n',
    's = "a # b" # c\n\'\'\'doc\n # x\'\'\'\nz = \'\'\'',
    'a """one""" b """two\nlines""" c',
    "url = 'http://x/y' // tail\r\n/* a\n * b */ NUM x1 1e5 NUM.\xa0\n",
    '\x1c\x1d lead\n\x1f\n\x85 tail \u3000',
    'def f(a,\n b): pass\nclass A: pass',
    'public static void sort(int[] a) { }',
    'function  go ( x ) { return "it\'s" }',
]


def run(spark, expr, language="python"):
    df = spark.createDataFrame([(i, s, language) for i, s in enumerate(SAMPLES)], "i int, code string, language string")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


@pytest.mark.parametrize("language, expected", [("python", WITHOUT_PYTHON_COMMENTS), ("java", WITHOUT_C_COMMENTS), ("cobol", SAMPLES)])
def test_remove_comments(spark, language, expected):
    assert run(spark, X.remove_comments(F.col("code"), F.col("language")), language) == expected


def test_whitespace_lines_strings_numbers(spark):
    code = F.col("code")
    assert run(spark, X.normalize_whitespace(code)) == WHITESPACE
    assert run(spark, X.remove_empty_lines(code)) == NO_EMPTY_LINES
    assert run(spark, X.normalize_strings(code)) == STRINGS
    assert run(spark, X.normalize_numbers(code)) == NUMBERS


def test_signatures(spark):
    python, java = (run(spark, X.function_signature(F.col("code"), F.col("language")), x) for x in ("python", "java"))
    assert python[6] == "def f(a,\n b)" and python[0] == ""
    assert java[7] == " void sort(int[] a)"
    assert set(run(spark, X.function_signature(F.col("code"), F.col("language")), "cobol")) == {""}


def test_missing_code_fails(spark):
    df = spark.createDataFrame([(None, None, None)], "code string, docstring string, language string")
    with pytest.raises(Exception, match="record without code"):
        R.fill_record_defaults(df).collect()


def test_requests(spark):
    df = spark.createDataFrame([(1, "q", None), (2, None, 5), (3, "q", 0), (4, "q", 101), (5, "q", 100)], "query_id int, query string, top_k int")
    valid, rejected = R.validate_requests(df)
    assert {(r.query_id, r.top_k) for r in valid.collect()} == {(1, 10), (5, 100)}
    assert {r.query_id for r in rejected.collect()} == {2, 3, 4}


def test_outline_of_blank_and_nested_code(spark):
    code = "\n\nclass A:\n  def f(self):\n\n    if x:\n      y\n\t\n  def g(self):\n    z\nend"
    rows = [(1, code, "python"), (2, "", "python"), (3, "x", "cobol"), (4, " \n ", "java")]
    nodes = outline_nodes(spark.createDataFrame(rows, "doc_id long, code string, language string")).orderBy("doc_id", "id").collect()
    one = [n for n in nodes if n.doc_id == 1]
    assert [n.parent_id for n in one] == [None, 0, 1, 2, 3, 1, 5, 0]
    assert [n.depth for n in one] == [0, 1, 2, 3, 4, 2, 3, 1]
    assert [n.child_count for n in one] == [2, 2, 1, 1, 0, 1, 0, 0]
    assert one[1].type == "class_declaration" and one[2].type == "function_definition" and one[3].type == "if_statement"
    assert one[2].start_point.row == 3 and one[2].start_point.col == 2
    assert [(n.doc_id, n.id) for n in nodes if n.doc_id != 1] == [(2, 0), (4, 0)]


def test_token_ids_pad_truncate_and_unknown(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, "c a a a a a")], "doc_id long, text string")
    vocab = token_vocab(docs, 2)
    assert [(r.token, r.token_id) for r in vocab.orderBy("token_id").collect()] == [("a", 2), ("b", 3)]
    for shipped in (10, 1):
        got = {r.doc_id: r for r in encode_tokens(docs, vocab, 4, shipped=shipped).collect()}
        assert got[1].input_ids == [3, 2, 3, 0] and got[1].attention_mask == [1, 1, 1, 0]
        assert got[2].input_ids == [0] * 4 and got[2].attention_mask == [0] * 4
        assert got[3].input_ids == [1, 2, 2, 2]
