"""The document language: values, errors and limits; pages over a directory; the command line."""

import json

import pytest

from vellum.functions.library import UNDEFINED, ScriptError
from vellum.operators.docset import DocSet
from vellum.plans import markdown, markup, page, template
from vellum.plans.script import Program, evaluate


@pytest.mark.parametrize(
    ("code", "value"),
    [
        ("1 + 2 * 3 ** 2", 19), ("'a' + 1 + null", "a1null"), ("[1, [2, [3]]].flat(9)", [1, 2, 3]), ("(a => a.b?.c ?? 'z')({b: null})", "z"), ("`x${`y${1 + 1}`}z`", "xy2z"),
        ("typeof nothing", "undefined"), ("1 / 0", float("inf")), ("-7 % 3", -1), ("0.1 + 0.2", 0.1 + 0.2), ("String(1e21) + String(1e-7)", "1e+211e-7"), ("(1.005).toFixed(2)", "1.00"), ("(255).toString(16)", "ff"),
        ("({a: 1, ...{b: 2}, ['c' + 1]: 3, d() { return 4 }}).d()", 4), ("(({a, b: [c, ...d], e = 5}) => [a, c, d, e].join())({a: 1, b: [2, 3, 4]})", "1,2,3,4,5"), ("[3, 1, 2].sort().reverse().concat([9], 8).join('')", "32198"),
        ("'aXbX'.split(/x/i).length", 3), ("'2024-03-09'.replace(/(\\d+)-(\\d+)/, '$2/$1')", "03/2024-09"), ("'a1b2'.replace(/[a-z]/g, (m, at) => m + at)", "a01b22"), ("[...'a1b2'.matchAll(/\\d/g)].map(m => m.index).join()", "1,3"),
        ("JSON.stringify({a: [1, undefined, NaN], b: undefined, c: new Date(0)}, null, 1)", json.dumps({"a": [1, None, None], "c": "1970-01-01T00:00:00.000Z"}, indent=1)), ("new Date(2024, 1, 31).toISOString()", "2024-03-02T00:00:00.000Z"), ("isNaN(new Date('x').getTime())", True),
        ("[...new Map([[1, 'a'], ['1', 'b']]).entries()].flat().join()", "1,a,1,b"), ("new Set([1, true, '1', 1]).size", 3), ("Object.fromEntries(Object.entries({x: 1}).map(([k, v]) => [k + k, v * 2])).xx", 2), ("null == undefined && null !== undefined", True),
        ("'ÉaZ'.toLowerCase()", "Éaz"), ("'abc'.substr(-2, 1) + 'abc'.substring(2, 0) + 'abc'.slice(-1)", "babc"), ("parseInt('0x1f') + parseInt('12px') + parseFloat('1.5e1x')", 58.0), ("5 & 3 | 8 ^ 2", 11), ("'b' in {b: 1}", True), ("[] instanceof Array", True), ("void 0", UNDEFINED),
    ],
)
def test_values(code, value):
    got = evaluate(code)
    assert got == value and isinstance(got, bool) == isinstance(value, bool)


def test_programs():
    text = "%% const f = (n) => {\n  return n < 2 ? n : f(n - 1) + f(n - 2)\n}\n= {{ f(10) }} \\{{ kept }}\n% let i = 0\n% do {\nrow {{ i++ }}{{ null }}\n% } while (i < 2)\n\\% no code"
    assert Program(text).run({}) == "= 55 {{ kept }}\nrow 0\nrow 1\n% no code"
    assert Program("% function g(x) { return x * 2 }\n% const {a, b: [c]} = {a: 1, b: [2]}\n{{ g(a + c) }}").run({}) == "6"
    for bad, message in (("% while (true) {\n% }", "too long"), ("{{ missing }}", "not defined"), ("% const a = 1\n% a = 2", "constant"), ("% throw 'x'", "x"), ("% const f = () => f()\n{{ f() }}", "too deep"), ("{{ ({}).x.y }}", "cannot read"), ("% if (1) {", "no end"), ("{{ 1 + }}", "unexpected"), ("{{ 'x'.repeat(1e12) }}", "invalid count")):
        with pytest.raises(ScriptError, match=message):
            Program(bad).run({}, 100_000)


@pytest.mark.parametrize("code", ["''.__class__", "[].constructor", "({}).__class__.__bases__", "Math.__dict__", "(x => x).call", "(x => x).__globals__", "JSON.parse.__self__", "process", "globalThis", "eval('1')", "new Date().ms", "Object.__init__"])
def test_nothing_else_is_reached(code):
    try:
        assert evaluate(code) is UNDEFINED
    except Exception as e:
        assert "Python" not in str(e) and type(e).__name__ in ("Thrown", "ScriptError")


@pytest.mark.parametrize("text", ["{{ reflect('java.lang.System', 'getProperty', 'user.home') }}", "{{ req.x.foo() }}", "{{ java_method }}", "% if exists(select 1) {\n% }", "{{ req.a; drop }}"])
def test_templates_reach_their_names_alone(text):
    with pytest.raises(template.TemplateError):
        template.template_sql(text)


def test_template_expressions(spark):
    rows = spark.createDataFrame([(1, "ab", [("x", 2)]), (2, None, None)], "k int, s string, items array<struct<n string, q int>>")
    text = "{{ req.s?.toUpperCase() ?? 'none' }} {{ (req.k + 1) * 2 }} {{ req.k > 1 && !(req.s === 'ab') ? 'yes' : 'no' }}\n% for (const i of req.items) {\n{{ i.n + '!' }}{{ req.items[0].q }}\n% }"
    assert [r.output for r in template.render_rows(rows, text, ["k", "s", "items"]).orderBy("k").collect()] == ["AB 4 no\nx!2", "none 6 yes"]


def test_pages(spark):
    docs = DocSet.from_texts(spark, ["+++\nt: card\n+++\n=== {{ req.name }}\n\n- x", "+++\nname: A\n+++", "+++\nname: B\n+++", "before {{ $.render({ t: 'card' }, { name: 'C' }) }} after\n\n{{ $.render(0, $.findOne({ name: 'B' })) }}{{ $.markdown('**m**') }}"])
    pages = page.Pages(docs)
    assert pages.html(3) == '<p>before Cx after</p><h3 id="b">B</h3><ul><li>x</li></ul><p><strong>m</strong></p>'
    assert pages.render_each(0)[:2] == ["=== A\n\n- x", "=== B\n\n- x"]
    assert pages.held
    pages.release()
    assert not pages.held
    with pytest.raises(ScriptError, match="leaves the folder"):
        pages.emit("../x", "y")
    with pytest.raises(ScriptError, match="nothing is found"):
        pages.text({"t": "none"})
    with pytest.raises(ScriptError, match="cannot be imported"):
        pages.module("../x.js")


def test_spliced_trees():
    held = {1: page.nested(markup.parse("= T\n\npara")), 2: page.nested(markup.parse("!!b!!"))}
    token = "{}".format
    tree = page.nested(markup.parse(f"{token(1)}\n\nin {token(2)} it {token(9)}"))
    assert page.html_of(tree, held) == '<h1 id="t">T</h1><p>para</p><p>in <strong>b</strong> it </p>'
    assert page.fill_tokens(f"x{token(2)}", held) == "x<p><strong>b</strong></p>"


def html_of(text):
    names = [n for n, _ in markup.NODE_FIELDS]
    return markup.write_html([dict(zip(names, r)) | {"props": list(r[6].items())} for r in markdown.parse(text)])


@pytest.mark.parametrize(
    ("text", "html"),
    [
        ("a\nb  \nc\\\nd", "<p>a\nb<br>\nc<br>\nd</p>"), ("***x** y* _a_b_", "<p><em><strong>x</strong> y</em> <em>a_b</em></p>"), ("1) a\n2) b\n\n- c\n\n- d", "<ol><li>a</li><li>b</li></ol><ul><li><p>c</p></li><li><p>d</p></li></ul>"),
        ("- a\n\n  para\n- b", "<ul><li><p>a</p><p>para</p></li><li><p>b</p></li></ul>"), ("> a\nlazy\n\nb", "<blockquote><p>a\nlazy</p></blockquote><p>b</p>"), ("<div class=x>\n*raw*\n</div>\n\nt &amp; &copy;", '<div class="x">\n*raw*\n</div><p>t &amp; ©</p>'),
        ("\\*a\\* `` ` `` www.a.b", '<p>*a* <code>`</code> <a href="http://www.a.b">www.a.b</a></p>'), ("", ""), ("# a\n# a", '<h1 id="a">a</h1><h1 id="a-1">a</h1>'),
    ],
)
def test_markdown(text, html):
    assert html_of(text) == html


def test_command_line(spark, tmp_path, capsys):
    from vellum.__main__ import context, main

    site, out = tmp_path / "site", tmp_path / "out"
    site.mkdir()
    (site / "main.mdy").write_text("= {{ req.title ?? 'none' }}\n% const lib = await import('./lib.js')\n% for (const p of $.find({ kind: 'post' })) {\n- {{ lib.shout(p.name) }}\n% $.emit(`${p.name}.txt`, $.text(p))\n% }\n")
    (site / "lib.js").write_text("export const shout = (s) => s.toUpperCase() + '!'\n")
    (site / "a.mdy").write_text("+++\nkind: post\n+++\ntext of {{ res.data.name }}")
    assert context(["-d", "a=1", "-d", "b=x y"]) == {"a": 1, "b": "x y"}
    assert main(["build", str(site), str(out), "-d", "title=Hello"]) == 0
    assert (out / "index.html").read_text() == '<h1 id="hello">Hello</h1><ul><li>A!</li></ul>' and (out / "a.txt").read_text() == "text of a"
    assert main(["html", str(site), str(tmp_path / "pages")]) == 0
    assert (tmp_path / "pages" / "a" / "index.html").read_text() == "<p>text of a</p>"
    assert main(["find", str(site), '{"kind": "post"}']) == 0 and '"kind": "post"' in capsys.readouterr().out
