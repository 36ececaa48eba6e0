import re

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomgraph.operators.chunker import split_sections

HEADING = re.compile(r"^(#{1,6})[\t\n\f\r ]+(.+)$", re.DOTALL)


def model(text):
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    lines = [line[:-1] if line.endswith("\r") else line for line in lines]
    trail, out, body, start = [""] * 6, [], [], 1

    def flush(at):
        content = "\n".join(body).strip()
        if content:
            out.append((" > ".join(t for t in trail if t) or "(top)", content, start, at))

    for n, line in enumerate(lines, 1):
        m = HEADING.match(line)
        if m and "\n" not in m.group(2):
            flush(n)
            level = len(m.group(1))
            trail[level - 1] = m.group(2).strip()
            trail[level:] = [""] * (6 - level)
            body, start = [], n
        else:
            body.append(line)
    flush(len(lines))
    return out


CASES = [
    "",
    "no heading\nat all",
    "preamble\n# One\ntext\n### Three\ndeep\n## Two\nback\n",
    "# Only heading\n## Another\n",
    "# A\r\n\r\nbody\r\n## B\r\nmore\r\n",
    "```\n# in a fence\n```\n",
    "#   \ntext under blanks\n####### seven\n#nospace\n",
    "# A\nx\n# A\nx\n",
    "# " + "long " * 2000 + "\n" + "word\n" * 3000,
]


def test_against_model(spark):
    df = spark.createDataFrame([(k, text) for k, text in enumerate(CASES)], "id long, text string")
    got = {}
    for r in split_sections(df, "id", "text").collect():
        got.setdefault(r.id, []).append((r.breadcrumb, r.content, r.line_start, r.line_end))
    for k, text in enumerate(CASES):
        assert sorted(got.get(k, [])) == sorted(model(text)), k


def test_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a", "y"), (2, "a", "y")], "id long, text string, content string")
    assert rows(split_sections(df, "id", "text")) == [(2, "(top)", "a", 1, 1)] * 2
    assert split_sections(df.limit(0), "id", "text").count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["# a", "## b", "### c", "text", "", "#", "###### f", "#\tt"]), max_size=12).map("\n".join), min_size=1, max_size=30))
def test_random_documents(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = sorted((r.id, r.breadcrumb, r.content, r.line_start, r.line_end) for r in split_sections(df, "id", "text").collect())
    assert got == sorted((k, *row) for k, text in enumerate(texts) for row in model(text))
