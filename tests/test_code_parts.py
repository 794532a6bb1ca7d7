"""Top-level constructs of languages with braces, around literals and comments that hold braces."""

import pytest

from textquarry.functions import chunking

CASES = {
    "go": ["func A() string {\n\treturn `{ raw }}` + \"}\" + string('{')\n}", "// } not code\nvar x = []int{1,\n\t2}", "/* { /* */\ntype T struct {\n\ta int\n}"],
    "rust": ["fn a<'a>(x: &'a str) -> &'a str {\n    let q = r#\"}} \"# ; let c = '{'; let d = '\\''; let e = '\\u{7d}';\n    x\n}", "/* { /* } */ } */\nstruct S<'b> {\n    s: &'b str,\n}", "const T: &str = \"two {\n lines\";"],
    "java": ["class A {\n  char c = '}';\n  char d = '\\u007d';\n  String s = \"\"\"\n    { \"quoted\" \\\"\"\" {\n    \"\"\";\n}", "interface B {\n  // }\n}"],
    "javascript": ["function a() {\n  return s.replace(/[{/}]/g, '{').split(/\\/{/);\n}", "const half = (x) => {\n  return x / 2 / 1; // }\n};", "const t = `{ ${1} } } '`;", "const u = 'it\\'s {';"],
}
CASES["typescript"] = [*CASES["javascript"], "export interface P {\n  a: string;\n}"]


@pytest.mark.parametrize("lang", sorted(CASES))
def test_parts(lang):
    content = "\n".join(CASES[lang])
    bare = chunking.bare_code(content, lang)
    assert len(bare) == len(content) and [len(x) for x in bare.split("\n")] == [len(x) for x in content.split("\n")]
    lines = content.split("\n")
    got = ["\n".join(lines[a:b]) for a, b in chunking._brace_parts(content, lang)]
    # a comment line before a construct is blank in the bare text, so it is no part of its own
    assert [g.split("\n", 1)[-1] if g.startswith(("//", "/*")) else g for g in got] == [c.split("\n", 1)[-1] if c.startswith(("//", "/*")) else c for c in CASES[lang]]


@pytest.mark.parametrize("lang", sorted(CASES))
def test_open_literals_and_comments_end(lang):
    for tail in ("/* open {", "\"open {", "`open {", "'", "/", "'''", "r#\"open"):
        assert len(chunking.bare_code("x\n" + tail, lang)) == len(tail) + 2
