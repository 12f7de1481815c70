from __future__ import annotations

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from corbel.sources import config, connect, css_tokens, dtcg_tokens, globs, markdown, markup, sinks

CSS = """/* { not: a block } */ @import "x.css"; @custom-variant dark (&:is(.dark *));
:root { --space-1: 4px; --space-1: 5px; --color-text: var(--gray-9); --last: 1px }
[data-theme='dark'] { --color-text: #fff; } .high-theme, .x { --color-text: red; }
@media (prefers-color-scheme: dark) { :root { --gray-9: #eee; } } @layer base { html { --gray-9: #111; } } @theme inline { --z-index-top: 9; } .card { --inner: 1; }"""


def test_css(spark):
    df = spark.createDataFrame([("s", 1, CSS), ("s", 2, ":root { --space-1: 9px; --more: 1; }"), ("s", 3, None), ("t", 4, "}{ --a: b;")], "system_id string, pos int, css string")
    got = {r[1]: r[2:] for r in rows(css_tokens.css_tokens(df))}
    assert got == {
        "--space-1": ("4px", None, "space", ()),
        "--color-text": ("var(--gray-9)", (("light", "var(--gray-9)"), ("dark", "#fff"), ("high", "red")), "color", ("--gray-9",)),
        "--gray-9": ("#111", (("dark", "#eee"), ("light", "#111")), "color", ()),
        "--z-index-top": ("9", None, "z-index", ()),
        "--more": ("1", None, "other", ()),
    }


def test_dtcg(spark):
    light = {"color": {"$type": "color", "brand": {"$value": "#00f", "$deprecated": True}, "text": {"$value": "{color.brand}", "$description": "Body"}}, "space": {"1": {"$type": "dimension", "$value": {"value": 4, "unit": "px"}}}, "old": {"value": 3}}
    shadow = {"shadow": {"x": {"$type": "shadow", "$value": {"color": "{color.brand}", "blur": 2}}}, "color": {"text": {"$type": "color", "$value": "#fff"}}}
    df = spark.createDataFrame([("s", 2, "light", json.dumps(light)), ("s", 1, "dark", json.dumps(shadow)), ("s", 3, None, "{broken")], "system_id string, pos int, theme string, json string")
    got = {r[1]: r[2:] for r in rows(dtcg_tokens.dtcg_tokens(df))}
    assert got["color.brand"] == ("#00f", None, "color", (), "Deprecated: deprecated")
    assert got["color.text"] == ("{color.brand}", (("dark", "#fff"), ("light", "{color.brand}")), "color", ("color.brand",), "Body")
    assert got["space.1"] == ("4px", None, "space", (), None) and got["old"] == ("3", None, "other", (), None)
    assert got["shadow.x"][0] == '{"color":"{color.brand}","blur":2}' and got["shadow.x"][3] == ("color.brand",)


def test_theme_of_file(spark):
    df = spark.createDataFrame([("a/tokens-dark.json",), ("hc.json",), ("dark/base.json",)], "p string")
    assert [r[0] for r in rows(df.select(dtcg_tokens.theme_of_file(F.col("p"), 3)))] == ["dark", "hc", None]
    assert [r[0] for r in rows(df.select(dtcg_tokens.theme_of_file(F.col("p"), 1)))] == [None] * 3


def test_globs(spark):
    paths = ["docs/a.md", "docs/x/b.md", "docs/x/b.mdx", "node_modules/docs/a.md", ".git/a.md", "src/a.figma.tsx", "a+b.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    take = lambda *args: [r[0] for r in rows(df.where(globs.matches(F.col("p"), *args)))]
    assert take(["docs/**/*.md"]) == ["docs/a.md", "docs/x/b.md"]
    assert take(["**/*.{md,mdx}"], ["docs/x/**"]) == ["docs/a.md", "a+b.md"]
    assert take(["**/?.figma.ts{,x}", "node_modules/docs/a.md"]) == ["node_modules/docs/a.md", "src/a.figma.tsx"]
    assert take(["a+b.md"]) == ["a+b.md"] and take([]) == []


def test_read_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.md").write_text("# A")
    (tmp_path / "b.txt").write_text("b")
    assert rows(globs.read_files(spark, str(tmp_path), ["**/*.md"])) == [("docs/a.md", "# A")]


def test_sections():
    text = "intro\n# One\nbody\n```\n# no\n~~~\n```\n### Three ###\n## Two\n~~~\n# no\n```\n~~~\nend\n# Next"
    got = markdown.sections(text, "file")
    assert [(h, t) for h, t, _ in got] == [("One", ["One"]), ("One", ["One"]), ("Three", ["One", "Three"]), ("Two", ["One", "Two"]), ("Next", ["Next"])]
    assert got[0][2] == "intro" and got[3][2].endswith("end") and got[4][2] == ""
    assert markdown.sections("just text", "file") == [("file", ["file"], "just text")] and markdown.sections("", "file") == []


def test_chunks_are_cut(spark):
    df = spark.createDataFrame([(1, "f", "# H\n" + "x" * 2000), (2, "f", None)], "doc_id int, title string, text string")
    assert [(r[2], len(r[4]), r[5]) for r in rows(markdown.chunked(df))] == [("H", 1200, True)]


def test_mentions(spark):
    names = spark.createDataFrame([("s", "Box"), ("s", "demo-button"), ("s", "demo-button-group"), ("t", "Pill"), (None, "Box")], "system_id string, name string")
    texts = spark.createDataFrame([(1, "s", "éBoxé `demo-button-group`, Boxes"), (2, "s", "Pill x_Box --demo-button--"), (3, "t", "Pill"), (4, "s", None)], "id int, system_id string, text string")
    assert sorted(rows(markdown.mentions(texts, names).select("id", "name"))) == [(1, "Box"), (1, "demo-button"), (1, "demo-button-group"), (2, "demo-button"), (3, "Pill")]


def test_patterns(spark):
    front = "---\ntitle: 'A form'\ndescription: Fields\nlanguage: html\n---\n# Other\ntext\n```tsx\n<X/>\n```\n"
    plain = "# Title\n\n```\ncode\n```\nfirst\nline\n\nsecond"
    df = spark.createDataFrame([(1, front), (2, plain), (3, "")], "doc_id int, text string")
    assert rows(markdown.patterns(df).orderBy("doc_id")) == [(1, "A form", "Fields", "html", "<X/>"), (2, "Title", "first line", None, "code"), (3, None, None, None, None)]


def test_changelogs(spark):
    text = "# Log\nBox early\n## 1.0 ##\n- Box one\n### Box\n- demo-button and Box"
    docs = spark.createDataFrame([(1, "s", text)], "doc_id int, system_id string, text string")
    names = spark.createDataFrame([("s", "Box"), ("s", "demo-button")], "system_id string, name string")
    got = sorted(rows(markdown.changelog_mentions(docs, names, 2)))
    assert [(r[1], r[2], r[4], r[5]) for r in got] == [("Box", 1, 2, ""), ("Box", 2, 4, "1.0"), ("demo-button", 1, 6, "Box")]


def test_markup():
    code = '<!-- <no> --><a-b x="1" y=\'2\' z w=3>\n<br/><a-b></a-b> text</a-b>\n<Tag {...p} on={() => <i>n</i>} s={"q"} /><style>p > a { }</style><open>'
    got = markup.scan(code)
    assert [(e[0], e[1], e[4]) for e in got] == [(1, "a-b", True), (2, "br", False), (2, "a-b", False), (3, "Tag", False), (3, "open", False)]
    assert got[0][2] == [("x", "1"), ("y", "2"), ("z", None), ("w", "3")] and got[3][2] == [("on", None), ("s", "q")] and got[3][3]


def test_imports():
    code = "import A, { B, C as D } from 'pkg/sub';\nimport * as N from \"n\";\nimport './side';"
    assert markup.imports(code) == [(1, "pkg/sub", "A", None), (1, "pkg/sub", "B", "B"), (1, "pkg/sub", "D", "C"), (2, "n", None, None), (3, "./side", None, None)]


def test_connections(spark):
    code = "figma.connect(ui.Button, 'https://f/x?node-id=1%3A2-3', { props: { tone: figma.enum('Tone', {A: 'a'}), odd: figma.magic('M') } })\nfigma.connect('x-y', 'u')\nfigma.connect(Broken"
    df = spark.createDataFrame([("a.figma.tsx", code), ("b", None)], "path string, text string")
    assert rows(connect.connected(df)) == [("a.figma.tsx", 0, "Button", "https://f/x?node-id=1%3A2-3", "1:2:3", (("tone", "enum", "Tone"), ("odd", "other", "M"))), ("a.figma.tsx", 1, "x-y", "u", "", ())]


@pytest.mark.parametrize("text, told", [(None, "no configuration"), ("{", "not valid JSON"), ('{"systems": []}', "must be an object"), ('{"systems": {}}', "no systems"), ('{"systems": {"a": {"catalog": {"adapter": "x"}}}}', "adapter must be one of")])
def test_config_errors(tmp_path, text, told):
    path = tmp_path / "c.json"
    if text is not None:
        path.write_text(text)
    with pytest.raises(config.ConfigError, match=told):
        config.read_config(str(path))


def test_config(spark, tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"systems": {"my-ds": {"root": "../ds", "catalog": {"adapter": "catalog-json"}, "tokens": {"adapter": "dtcg", "files": ["t.json"]}}}}))
    assert rows(config.systems(spark, str(path)).select("id", "root", "data_dir", "token_files")) == [("my-ds", str(tmp_path.parent / "ds"), str(tmp_path / "data/my-ds"), ("t.json",))]
    monkeypatch.setenv("MY_DS_DIR", "/elsewhere")
    assert rows(config.systems(spark, str(path)).select("root")) == [("/elsewhere",)]


def test_write_if_changed(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, generated_at string")
    assert sinks.write_if_changed(df, path) and not sinks.write_if_changed(df.withColumn("generated_at", F.lit("later")), path)
    assert sinks.write_if_changed(df.where("id = 1"), path) and spark.read.parquet(path).count() == 1


def test_upsert_section():
    first = sinks.upsert_section("# Mine\n", "x", "one")
    assert first == "# Mine\n\n<!-- begin x -->\none\n<!-- end x -->\n"
    assert sinks.upsert_section(first + "tail", "x", "two") == first.replace("one", "two") + "tail"
