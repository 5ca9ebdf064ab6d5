import random

import pytest

from treeline.llm import sourcefiles as S

NODES = "node_id bigint, repo_slug string, node_path string, node_name string, node_kind string, extension string, is_binary boolean, scanned_at timestamp, reason string, content string"

HAND = """// Copyright the mine authors. See LICENSE.

package gate

func hideDesk(clock int) (int, error) {
    // do not edit the cache by hand
	if clock > 29 {
		return accumulate(clock - 2), nil
	}
	return clock + 29, nil
}

const banner = `// Code generated by us. DO NOT EDIT.`

func showRing(size int) int {
	steps := []int{0, 1, 4, 9, 16, 25}
	return steps[size] + other(size)
}
"""
GENERATED = "package p\n" + "".join(f"func (m *T) GetField{i}() int64 {{\n\tif m != nil {{\n\t\treturn m.Field{i}\n\t}}\n\treturn 0\n}}\n" for i in range(12))
MINIFIED = "".join(f"function {c}(x){{return x+{i}}}var q{c}=e.{c}||{i};" for i, c in enumerate("abcdefghijklmnop"))
DATA = "TABLE = {\n" + "".join(f' "key{i}": {i * 7919},\n' for i in range(40)) + "}\n"


TEST_FILE = "package p\n" + "".join(
    f'func Test{n}(t *testing.T) {{\n\tgot := Parse("{w}")\n\tif got != "{v}" {{\n\t\tt.Fatalf("got %v", got)\n\t}}\n}}\n\n'
    for n, w, v in zip("Empty Blank Word Line Tab Quote Brace Comma Digit Sign Path Name".split(), "abcdefghijkl", "mnopqrstuvwx")
)
SWITCH = "func name(k int) string {\n\tswitch k {\n" + "".join(f'\tcase {i}:\n\t\treturn "{w}"\n' for i, w in enumerate("one two three four five six seven eight nine ten eleven".split())) + '\t}\n\treturn ""\n}\n'


@pytest.mark.parametrize(
    "ext,text,lines",
    [
        ("py", "w = w // 2 + h  # half\nif w: x = f(a,\n  'b#c')\n", ["w=w//2+h", "if w:x=f(a,'b#c')"]),
        ("py", 's = """a # b\n"""\ny = 1; z = 2\n', ['s="""a # b\n"""', "y=1", "z=2"]),
        ("rs", "fn f<'a, T: 'a>(x: &'a str) -> char { /* c */ 'x' }", ["fn f<'a,T:'a>(x:&'a str)->char{", "'x'", "}"]),
        ("rs", 'let r = r#"a " b"#; let b = b\'q\';', ['let r=r#"a " b"#', "let b=b'q'"]),
        ("js", 'class A { #count = 0; m() { return /["]/.test(this.#count) } }\nlet b = a / c / d;', ["class A{", "#count=0", "m(){", 'return /["]/.test(this.#count)', "}", "}", "let b=a/c/d"]),
        ("ts", "const t = `a ${b} // c`\nfoo({a: 1, b: 2})\n", ["const t=`a ${b} // c`", "foo({a:1,b:2})"]),
        ("c", '#include <a.h>\n#define X(a) \\\n  (a)\nint f(int a) { for (;;) { g("}"); } }', ["#include <a.h>", "#define X(a) \\ (a)", "int f(int a){", "for(;;){", 'g("}")', "}", "}"]),
        ("css", ".a{margin:7px;color:#fff}/* x */ .b { background: url(x;y.png) }", [".a{", "margin:7px", "color:#fff", "}", ".b{", "background:url(x;y.png)", "}"]),
        ("java", "int a = 1;\nchar c = '\\u0041'; // s\nString s = \"a;b\";", ["int a=1", "char c='\\u0041'", 'String s="a;b"']),
    ],
)
def test_lexer_and_printer(ext, text, lines):
    assert S.printed(S.lexemes(text, ext), ext) == lines


@pytest.mark.parametrize(
    "text,ext,reason",
    [
        (HAND, "go", None),
        (GENERATED, "go", "generated"),
        (MINIFIED, "js", "minified"),
        (DATA, "py", "data"),
        ("const b = `" + "".join(random.Random(1).choices("ABCDEFabcdef0123456789+/", k=3000)) + "`\n", "go", "data"),
        ("// Vendored from x/y at 1.2.3; upstream bugs go upstream.\n" + HAND, "go", "third-party"),
        (HAND.replace("mine", "theirs"), "go", "third-party"),
        ("/* Generated by the x compiler. */\nint f(int a);\n", "c", "generated"),
        ("\x01\ufffdRIFF" + "\ufffd" * 40, "py", "data"),
        ("", "go", None),
        (None, "go", None),
        (TEST_FILE, "go", None),
        (SWITCH, "go", None),
        ("# The report is generated each night by cron.\nimport os\n", "py", None),
        ("def half(w, h):\n    return w // 2 + h\n\ndef third(w):\n    return w // 3\n", "py", None),
        ("﻿" + HAND.replace("\n", "\r\n"), "go", None),
        (".a {\n  margin: 7px;\n}\n\n.b {\n  margin: 8px;\n}\n", "css", None),
    ],
)
def test_judge(text, ext, reason):
    assert S.judge(text, ext, "mine") == reason


@pytest.mark.parametrize("tail", ["\x01\ufffd" * 300, "\x01\ufffd" * 3000])
def test_binary_data_behind_a_plain_head(tail):
    r = random.Random(2)
    plain = HAND + "".join("// " + "".join(r.choices("abcdefgh ", k=60)) + "\n" for _ in range(90))
    assert len(plain) > 4096 and S.judge(plain, "go", "mine") is None
    assert S.judge(plain + "// " + tail, "go", "mine") == "data"
    assert S.judge(plain + "// " + tail + "\n" + plain, "go", "mine") == "data"
    assert S.judge(plain + "// \x01\n", "go", "mine") is None


def test_very_long_text_is_lexed_whole():
    long = HAND * 300
    assert S.judge(long, "go", "mine") in (None, "generated")
    assert S.judge("x = [" + ", ".join(map(str, range(200_000))) + "]", "py", "mine") == "data"


def test_files(spark):
    def node(i, path, ext="go", kind="file"):
        return (i, path.split("/")[0], path, path.split("/")[-1], kind, ext, None, None, "x", "y")

    nodes = [
        node(1, "mine/a/b.go"),
        node(1, "mine/a/b.go", " .GO"),
        node(2, "mine/a/gen.go", None),
        node(3, "mine/vendor/pkg/x.go"),
        node(4, "mine/app/models/vendor/x.go"),
        node(5, "mine/a/b.pb.go"),
        node(6, "mine/readme.md", "md"),
        node(7, "mine/a", None, "dir"),
        node(8, "mine/copy.go"),
        node(9, "mine/third_party/pkg/orig.go"),
        node(10, "mine/vendors/pkg/x.go"),
        (12, "mine", "mine/blob.go", "blob.go", "file", "go", True, None, None, None),
        (11, None, None, None, "file", "js", None, None, None, None),
        (None, "mine", "mine/z.go", "z.go", "file", "go", None, None, None, None),
    ]
    body = "package q\n" + "".join(f"func f{c}(a int) int {{\n\treturn a + g{c}{c}(a)\n}}\n" for c in "ab")
    contents = [(1, HAND, "n"), (2, GENERATED, "n"), (4, HAND, "n"), (8, body, "n"), (9, "// theirs\n" + body, "n"), (10, HAND, "n"), (99, HAND, "n")]
    got = {r.node_id: r.reason for r in S.judged_files(spark.createDataFrame(nodes, NODES), spark.createDataFrame(contents, "node_id bigint, content string, reason string")).collect()}
    assert got == {1: None, 2: "generated", 3: "third-party", 4: None, 5: "generated", 8: "third-party", 9: "third-party", 10: None, 11: None, 12: "data"}
    empty = S.judged_files(spark.createDataFrame([], NODES), spark.createDataFrame([], "node_id bigint, content string"))
    assert empty.count() == 0
