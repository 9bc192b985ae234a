"""Goldens for layout, search, motions, text objects, spans and state, and properties of the layout."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import layout, lines, motion, search, spans, state, textobj, tools, viewport


def one(spark, column, **values):
    """The value of one expression over one row."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {_kind(v)}" for k, v in values.items()))
    found = row.select(column.alias("x")).first()["x"]
    return found.asDict(recursive=True) if hasattr(found, "asDict") else found


def _kind(v):
    return {str: "string", int: "int", list: "array<string>"}[type(v)]


LS, I, C = "ls", "i", "c"


def at(spark, f, ls, i, c, *args, **kw):
    found = one(spark, f(F.col(LS), F.col(I), F.col(C), *args, **kw), ls=ls, i=i, c=c)
    return found and (found["line"], found["col"])


def span(spark, f, line, c, *args, **kw):
    found = one(spark, f(F.col(LS), F.col(I), F.col(C), *args, **kw), ls=[line], i=0, c=c)
    return found and (found["start"]["col"], found["end"]["col"])


# --- layout ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "width", "want"),
    [
        ("aa bb cc dddd", 10, ["aa  bb  cc", "dddd", ""]),
        ("aa bb cc dddd", 11, ["aa   bb  cc", "dddd", ""]),
        ("a\n\n\nb", 10, ["a", "", "b", ""]),
        ("", 10, [""]),
        ("abcdefghijk", 10, ["abcdefghij", "k", ""]),
        ("abcdefghij", 10, ["abcdefghij", ""]),
        ("éé éé", 4, ["éé", "éé", ""]),
        ("éééé", 3, ["ééé", "é", ""]),
    ],
)
def test_justify_goldens(text, width, want):
    assert layout.justified(text, width) == want


def test_justify_rejects_no_width(spark):
    with pytest.raises(ValueError):
        layout.justify(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 0)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t", max_size=80), st.integers(1, 12))
def test_justify_keeps_words_and_width(text, width):
    out = layout.justified(text, width)
    pieces = [p[i : i + width] for p in text.split() for i in range(0, len(p), width)]
    assert " ".join(out).split() == pieces
    assert all(len(x.encode()) <= width or " " not in x for x in out)


def test_justify_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dddd", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, line string")
    rows = layout.justify(docs, 10).orderBy("doc_id", "line_idx").collect()
    assert [(r.doc_id, r.line_idx, r.line) for r in rows] == [(1, 0, "aa  bb  cc"), (1, 1, "dddd"), (1, 2, ""), (3, 0, "")]


def test_words_split_on_unicode_space(spark):
    assert one(spark, tx.words(F.col("t")), t="a b  c") == ["a", "b", "c"]
    assert one(spark, tx.hard_split(tx.words(F.col("t")), 2), t="abcde f") == ["ab", "cd", "e", "f"]


def test_line_relation_counts_bytes(spark):
    docs = spark.createDataFrame([(1, "é\n\nab")], "doc_id long, text string")
    rel = lines.line_relation(docs)
    assert [(r.line_idx, r.abs_byte, r.n_bytes, r.n_chars, r.is_blank) for r in rel.orderBy("line_idx").collect()] == [(0, 0, 2, 1, False), (1, 3, 0, 0, True), (2, 4, 2, 2, False)]
    offsets = spark.createDataFrame([(1, x) for x in (0, 2, 3, 4, 6, 7)], "doc_id long, abs_byte long")
    found = lines.to_positions(offsets, rel).orderBy("abs_byte").collect()
    assert [(r.abs_byte, r.line, r.byte_col) for r in found] == [(0, 0, 0), (2, 0, 2), (3, 1, 0), (4, 2, 0), (6, 2, 2)]


# --- search ---------------------------------------------------------------------------------------

CATS = ["The cat", "a cat cat", "dog"]


def hit(spark, f, *args, **kw):
    found = one(spark, f, **kw)
    return found and (found["line"], found["start"], found["end"])


def test_search_goldens(spark):
    ls, i, c = F.col("ls"), F.col("i"), F.col("c")
    assert hit(spark, search.preview_match(ls, i, c, "CAT"), ls=CATS, i=0, c=0) == (0, 4, 7)
    assert hit(spark, search.preview_match(ls, i, c, "CAT"), ls=CATS, i=0, c=4) == (0, 4, 7)
    assert hit(spark, search.next_match(ls, i, "CAT"), ls=CATS, i=1) == (0, 4, 7)
    assert hit(spark, search.next_match(ls, i, "CAT", forward=False), ls=CATS, i=0) == (1, 6, 9)
    assert hit(spark, search.preview_match(ls, i, c, "CAT", forward=False), ls=CATS, i=2, c=0) == (1, 2, 5)
    assert hit(spark, search.preview_match(ls, i, c, "zzz"), ls=CATS, i=0, c=0) is None
    assert hit(spark, search.next_match(ls, i, ""), ls=CATS, i=0) is None
    assert one(spark, tx.find_all(F.col("t"), "a.a"), t="xa.ayA.A") == [1, 5]


# --- motions --------------------------------------------------------------------------------------

TEXT = ["foo_bar, baz", "", "  next."]


def test_motion_goldens(spark):
    assert at(spark, motion.word_forward, TEXT, 0, 0) == (0, 7)
    assert at(spark, motion.word_forward, TEXT, 0, 0, big=True) == (0, 9)
    assert at(spark, motion.word_end, TEXT, 0, 0) == (0, 6)
    assert at(spark, motion.word_forward, TEXT, 0, 7) == (0, 9)
    assert at(spark, motion.word_forward, TEXT, 0, 9) == (2, 2)
    assert at(spark, motion.word_back, TEXT, 0, 9) == (0, 7)
    assert at(spark, motion.word_back, TEXT, 2, 2) == (2, 0)
    assert at(spark, motion.sentence_forward, TEXT, 0, 0) == (2, 6)
    assert at(spark, motion.sentence_back, TEXT, 2, 6) == (0, 0)
    assert at(spark, lambda ls, i, c: motion.line_end(ls, i), TEXT, 0, 0) == (0, 11)
    assert at(spark, lambda ls, i, c: motion.paragraph_forward(ls, i), TEXT, 0, 0) == (2, 0)
    assert at(spark, lambda ls, i, c: motion.paragraph_back(ls, i), TEXT, 2, 0) == (1, 0)
    assert at(spark, motion.matching_bracket, ["(a [b] c)"], 0, 0) == (0, 8)
    assert at(spark, motion.matching_bracket, ["f(", " (x)", ")"], 2, 0) == (0, 1)
    assert at(spark, motion.matching_bracket, ["a)"], 0, 1) is None
    assert at(spark, motion.find_char, ["abcabc"], 0, 0, "c", till=True) == (0, 1)


def test_motions_at_the_edges(spark):
    assert at(spark, motion.word_forward, ["ab"], 0, 0) == (0, 2)
    assert at(spark, motion.word_back, ["ab"], 0, 0) == (0, 0)
    assert at(spark, motion.word_end, ["ab  "], 0, 3, big=True) == (0, 3)
    assert at(spark, motion.sentence_forward, ["no mark"], 0, 0) == (0, 6)
    assert at(spark, motion.step, ["abc", "d"], 0, 2, down=1) == (1, 0)
    assert at(spark, motion.step, ["abc", "d"], 1, 0, down=1) == (1, 0)


# --- text objects ---------------------------------------------------------------------------------


def test_text_object_goldens(spark):
    assert span(spark, textobj.inner_word, "foo bar baz", 5) == (4, 7)
    assert span(spark, textobj.around_word, "foo bar baz", 5) == (3, 8)
    assert span(spark, textobj.sentence, "A b. 3.14 c!", 5) == (5, 7)
    assert span(spark, textobj.delimited, "f(a(b)c)", 4, "(") == (4, 5)
    assert span(spark, textobj.delimited, "f(a(b)c)", 4, "(", around=True) == (3, 6)
    assert span(spark, textobj.quoted, 'say "hi" now', 5) == (5, 7)
    assert span(spark, textobj.quoted, 'say "hi" now', 5, around=True) == (4, 8)
    assert span(spark, textobj.delimited, "f()", 1, "(") is None
    assert span(spark, textobj.delimited, "f()", 2, "(") is None
    assert span(spark, textobj.delimited, "(a(b))", 3, "(") == (3, 4)
    assert span(spark, textobj.delimited, "(a(b))", 2, "(") == (3, 5)
    assert span(spark, textobj.delimited, "(a(b))", 4, "(") == (1, 4)
    assert span(spark, textobj.inner_word, "a b", 1) is None
    start, end = motion.position(F.lit(0), F.lit(1)), motion.position(F.lit(0), F.lit(3))
    assert one(spark, textobj.extract(F.col("ls"), start, end), ls=["abcdef"]) == "bc"
    assert one(spark, textobj.extract(F.col("ls"), end, start), ls=["abcdef"]) == "bc"


# --- spans ----------------------------------------------------------------------------------------


def frame(spark, rows, names="doc start end"):
    return spark.createDataFrame([(1, *r) for r in rows], ", ".join(f"{n} long" for n in names.split()))


def pairs(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def test_highlight_goldens(spark):
    base = frame(spark, [(10, 20), (25, 35), (40, 50)])
    cut = frame(spark, [(15, 30)], "doc r_start r_end")
    assert pairs(spans.remove_overlapping(base, cut)) == [(40, 50)]
    assert pairs(spans.removed_by(base, cut)) == [(10, 20), (25, 35)]
    single = frame(spark, [(10, 20)])
    for s, e, n in ((0, 5, 0), (20, 30, 0), (25, 30, 0), (5, 15, 1), (15, 25, 1), (12, 18, 1), (5, 25, 1)):
        assert spans.overlapping(single, frame(spark, [(s, e)], "doc r_start r_end"), 4).count() == n
    assert pairs(spans.add_highlights(single, frame(spark, [(10, 20), (5, 6), (5, 6)]))) == [(5, 6), (10, 20)]
    assert pairs(spans.merged(frame(spark, [(0, 5), (5, 9), (12, 14)]), "doc")) == [(0, 9), (12, 14)]
    toggles = frame(spark, [(1, 10, 20), (2, 25, 35), (3, 15, 30)], "doc seq start end")
    assert pairs(spans.toggled(toggles)) == []
    layers = frame(spark, [(0, 2, 8), (1, 5, 12)], "doc rank start end")
    assert [(r["rank"], r["seg_start"], r["seg_end"]) for r in spans.layered(layers, "doc").orderBy("seg_start").collect()] == [(0, 2, 8), (1, 8, 12)]


# --- state, viewport, tools -----------------------------------------------------------------------


def test_progress_percentages(spark):
    assert one(spark, state.stored_percentage(F.lit(50), F.lit(100)), x=1) == 50.0
    assert one(spark, state.stored_percentage(F.lit(5), F.lit(0)), x=1) is None
    assert one(spark, state.shown_percentage(F.lit(99), F.lit(100)), x=1) == 100.0
    assert one(spark, state.shown_percentage(F.lit(0), F.lit(0)), x=1) == 100.0


def test_latest_breaks_ties_by_sequence(spark):
    rows = spark.createDataFrame([("a", 1, 1, 5), ("a", 1, 2, 6), ("b", 9, 1, 7)], "doc string, ts int, seq int, offset int")
    assert {r.doc: r.offset for r in state.latest_progress(rows).collect()} == {"a": 6, "b": 7}


def test_centering_saturates(spark):
    found = one(spark, viewport.centered(F.lit(8), F.lit(10), F.lit(20)), x=1)
    assert found == {"offset": 0, "cursor_y": 8}


@pytest.mark.parametrize(("command", "ok"), [*((c, True) for c in "cat less head tail grep ls pwd".split()), *((c, False) for c in ("rm", "sudo", "kill", "reboot", "cat file; rm file", "echo `cmd`", "ls > file", "cat x | y", ""))])
def test_command_guard(spark, command, ok):
    assert one(spark, tools.command_allowed(F.col("c")), c=command) is ok


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("ls", "Get-ChildItem | Select-Object -ExpandProperty Name"),
        ("ls -la", "Get-ChildItem -Force | Format-Table Mode, LastWriteTime, Length, Name"),
        ("ls -l /tmp", "Get-ChildItem -Path /tmp | Format-Table Mode, LastWriteTime, Length, Name"),
        ("cat file.txt", "Get-Content file.txt"),
        ("grep -i pattern file.txt", 'Select-String -Pattern "pattern" -Path "file.txt" -CaseSensitive:$false'),
        ("grep -n pattern file.txt", 'Select-String -Pattern "pattern" -Path "file.txt" | Format-Table LineNumber, Line'),
        ("head -n5 a", "Get-Content a -First 5"),
        ("head -n 5 a", "Get-Content a -First 5"),
        ("tail a", "Get-Content a -Tail 10"),
        ("pwd", "Get-Location"),
        ("make x", "make x"),
        ("", ""),
    ],
)
def test_translation(command, want):
    assert tools.translated(command) == want


def test_uniq_counts_adjacent_lines(spark):
    docs = spark.createDataFrame([(1, "a\na\nb\na"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.line_idx, r.line, r.n) for r in tools.uniq(docs).orderBy("doc_id", "line_idx").collect()] == [(1, 0, "a", 2), (1, 2, "b", 1), (1, 3, "a", 1), (2, 0, "", 1)]


def test_tools_in_the_row(spark):
    docs = spark.createDataFrame([(1, "b\n\na\nc"), (2, None)], "doc_id long, text string")
    assert [(r.line_idx, r.number) for r in tools.nl(docs).orderBy("line_idx").collect()] == [(0, 1), (1, None), (2, 2), (3, 3)]
    assert [r.line for r in tools.sorted_lines(docs).orderBy("rank").collect()] == ["", "a", "b", "c"]
    rows = tools.numbered(docs).select("line", tools.in_head(1).alias("h"), tools.in_tail(1).alias("t")).collect()
    assert [(r.line, r.h, r.t) for r in rows if r.h or r.t] == [("b", True, False), ("c", False, True)]
    assert one(spark, tools.translation(F.col("c")), c="ls /tmp") == tools.translated("ls /tmp")


def test_running_sums_over_blocks(spark):
    sizes = [k * 7 % 5 for k in range(700)]
    rows = spark.createDataFrame([(sizes,), ([],), ([3],)], "x array<bigint>")
    want = [sum(sizes[:k]) for k in range(700)]
    for block in (1, 128, 1000):
        assert [r.s for r in rows.select(tx.running_before(F.col("x"), block).alias("s")).collect()] == [want, [], [0]]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_line_plans_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "a b\nc")], "doc_id long, text string")
    for df in (lines.line_relation(docs), lines.line_index(docs), lines.word_rows(docs), tools.nl(docs), tools.uniq(docs), tools.sorted_lines(docs), tools.numbered(docs)):
        assert _exchanges(df) == 0 and "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_search_columns_are_the_lines_own(spark):
    """Letters whose lower case is longer don't shift what follows them."""
    assert one(spark, tx.find_first(F.col("t"), "the"), t="İİ the") == 3 == one(spark, tx.find_last(F.col("t"), "THE"), t="İİ the")
    assert one(spark, tx.find_all(F.col("t"), "the"), t="the İ theİthe") == [0, 6, 10]


def test_many_cursors_in_a_row(spark):
    docs = spark.createDataFrame([(["ab cd", "", "ef"], [(0, 0), (0, 3), (2, 0)])], "ls array<string>, c array<struct<line:int,col:int>>")
    found = docs.select(motion.each(F.col("c"), lambda line, col: motion.word_forward(F.col("ls"), line, col)).alias("to")).first().to
    assert [(x.line, x.col) for x in found] == [(0, 3), (2, 0), (2, 2)]


def test_similarity_of_whole_texts(spark):
    assert one(spark, tx.similarity(F.lit("kitten"), F.lit("sitting")), x=1) == {"distance": 3, "percent": pytest.approx(100 * (1 - 3 / 7))}
    assert one(spark, tx.similarity(F.lit(""), F.lit("")), x=1)["percent"] == 100


def test_cleared_highlights(spark):
    have = spark.createDataFrame([(1, 0, 5), (2, 0, 5)], "doc long, start long, end long")
    assert [r.doc for r in spans.cleared(have, spark.createDataFrame([(1,)], "doc long")).collect()] == [2]


def test_shared_folder_is_not_private_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from lectern.session import shared_folder

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context, conf={}))
