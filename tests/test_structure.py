from codegrain.functions.text import windows_of
from codegrain.operators import structure as st

SOURCE = r"""/* head */
#ifndef GUARD_H
#define GUARD_H
#include "local/a.h"
#include <stdio.h> // system
#define MAX(a, b) ((a) > (b) ? (a) : (b)) \
    + 0
typedef struct node { int v; struct node *next; } node_t;
enum color { RED, GREEN };
static int counter = 0, *where;
extern int proto(int a, char *b);
void (*handler)(int);
namespace deep { namespace er {
class Thing { int x; };
int method(Thing &t) { return t.run(1) + other::call(2); }
} }
extern "C" {
static int helper(const char *s, int n)
{
    char buf[8]; /* not a call: f( */
    for (int i = 0; i < n; i++) { buf[i] = s[i]; if (i > 3) continue; }
    strcpy(buf, "text with ) and {");
    p->field.go(3);
    (*handler)(n);
    return MAX(n, sizeof(buf));
}
}
#endif
"""


def test_items_partition_and_kinds():
    outcome, spans = st.spans(SOURCE)
    assert outcome == "PARSE_SUCCESS"
    assert spans[0]["start"] == 0 and spans[-1]["end"] == len(SOURCE.encode())
    assert all(a["end"] == b["start"] for a, b in zip(spans, spans[1:]))
    kinds = {k for s in spans for k in s["kinds"]}
    assert {"MACRO", "TYPE", "FUNCTION", "DECLARATION", "PREPROCESSOR"} <= kinds
    assert all(len(s["kinds"]) == 1 for s in spans if "FUNCTION" in s["kinds"])


def test_symbols():
    got = {(s["symbol_kind"], s["qualified_name"], s["role"], s["linkage"]) for s in st.extract(SOURCE)["symbols"]}
    assert {
        ("MACRO", "MAX", "DEFINITION", "EXTERNAL"), ("STRUCT", "node", "DEFINITION", "EXTERNAL"), ("TYPEDEF", "node_t", "DEFINITION", "EXTERNAL"), ("ENUM", "color", "DEFINITION", "EXTERNAL"),
        ("GLOBAL_VARIABLE", "counter", "DECLARATION", "INTERNAL"), ("FUNCTION", "proto", "DECLARATION", "EXTERNAL"), ("CLASS", "deep::er::Thing", "DEFINITION", "EXTERNAL"),
        ("FUNCTION", "deep::er::method", "DEFINITION", "EXTERNAL"), ("FUNCTION", "helper", "DEFINITION", "INTERNAL"), ("NAMESPACE", "deep::er", "DEFINITION", "EXTERNAL"),
    } <= got
    helper = next(s for s in st.extract(SOURCE)["symbols"] if s["name"] == "helper")
    assert helper["parameters"] == ["const char * s", "int n"] and helper["conditional_depth"] == 1
    assert helper["signature"] == "static int helper(const char *s, int n)"
    assert helper["facts"]["loops"] == 1 and helper["facts"]["conditions"] == 1 and helper["facts"]["returns"] == 1 and helper["facts"]["sizeof_expressions"] == 1


def test_calls_and_includes():
    got = st.extract(SOURCE)
    calls = {(c["name"], c["kind"], c["caller"]) for c in got["calls"]}
    assert calls == {
        ("run", "MEMBER", "deep::er::method"), ("call", "QUALIFIED", "deep::er::method"), ("strcpy", "DIRECT_IDENTIFIER", "helper"), ("go", "MEMBER", "helper"),
        (None, "INDIRECT", "helper"), ("MAX", "DIRECT_IDENTIFIER", "helper"),
    }
    assert [(i["spelling"], i["target"]) for i in got["includes"]] == [('"local/a.h"', "local/a.h"), ("<stdio.h>", "stdio.h")]


def test_malformed_and_empty():
    outcome, spans = st.spans("int main( {\n  return 0;\n")
    assert outcome == "FALLBACK_SUCCESS" and spans[-1]["end"] == 24 and {s["kind"] for s in spans} == {"LINE_WINDOW"}
    assert st.spans("") == ("FALLBACK_SUCCESS", []) and st.parse("")["fallback_reason"] == "empty_blob"


def test_large_function_is_cut_within_its_unit():
    text = "int f(void)\n{\n" + "".join(f"  x{i} = y{i} + {i};\n" for i in range(900)) + "}\nint g(void) { return 1; }\n"
    outcome, spans = st.spans(text)
    assert outcome == "PARSE_SUCCESS" and all(s["end"] - s["start"] <= 3000 for s in spans)
    assert spans[0]["kind"] == "AST_BLOCK" and spans[0]["parent"] == "FUNCTION" and spans[-1]["kind"] == "FUNCTION"
    assert spans[-1]["end"] == len(text)


def test_windows_are_exact_and_cut_at_characters():
    import random

    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab\n é€😀\r\n") for _ in range(rng.randint(0, 200)))
        found = windows_of(text, 31)
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b, _, _ in found) == raw
        for a, b, c, d in found:
            assert 0 < b - a <= 31 and raw[a:b].decode() == text[c:d]


def test_chunk_files(spark):
    files = spark.createDataFrame([("a.c", SOURCE.encode()), ("b.c", "// caf\xe9\nint x;\n".encode("cp1252")), ("c.c", b"a\0b"), ("d.c", b"")], "path string, raw binary")
    got = st.chunk_files(files).collect()
    assert {(r.path, r.outcome, r.encoding, r.fallback_reason) for r in got} == {
        ("a.c", "FALLBACK_SUCCESS", "utf-8", "syntax_error_or_missing_node"), ("b.c", "FALLBACK_SUCCESS", "cp1252", "non_utf8_source"), ("c.c", "TERMINAL_ERROR", None, "nul_byte"), ("d.c", "FALLBACK_SUCCESS", "utf-8", "empty_blob")
    }
    (b,) = [r for r in got if r.path == "b.c"]
    assert (b.start_byte, b.end_byte, b.start_line, b.end_line, b.end_point_line, b.end_column) == (0, 15, 1, 2, 3, 0) and b.content_bytes == 16
    found = st.extract_files(spark.createDataFrame([("a.c", SOURCE), ("n.c", None)], "path string, text string"))
    assert found.where("tag = 'call'").count() == 6 and found.where("tag = 'include'").count() == 2


def test_class_scopes_and_inline_methods():
    text = """class Outer : public Base {
public:
    Outer() : n(0) { reset(1); }
    int get() const { return helper(this->n); }
    void set(int v);
    struct Inner { int x; };
    bool operator==(const Outer &o) const { return n == o.n; }
private:
    int n;
};
struct Plain { void run() { go(); } };
template <class T> class Box { T take() { return make<T>(); } };
template <typename T> T twice(T v) { return v + v; }
"""
    got = st.extract(text)
    found = {(s["symbol_kind"], s["qualified_name"], s["role"]) for s in got["symbols"]}
    assert {
        ("CLASS", "Outer", "DEFINITION"), ("FUNCTION", "Outer::Outer", "DEFINITION"), ("FUNCTION", "Outer::get", "DEFINITION"), ("FUNCTION", "Outer::operator==", "DEFINITION"),
        ("FUNCTION", "run", "DEFINITION"), ("CLASS", "Box", "DEFINITION"), ("FUNCTION", "Box::take", "DEFINITION"), ("FUNCTION", "twice", "DEFINITION"), ("STRUCT", "Plain", "DEFINITION"),
    } <= found and ("CLASS", "T", "DECLARATION") not in found
    assert {(c["name"], c["caller"]) for c in got["calls"]} >= {("reset", "Outer::Outer"), ("helper", "Outer::get"), ("go", "run")}
    assert sum(s["symbol_kind"] == "STRUCT" and s["name"] == "Inner" for s in got["symbols"]) == 1


def test_types_in_bodies_and_anonymous_ones():
    got = {(s["symbol_kind"], s["name"], s["role"]) for s in st.extract("typedef struct T { int a; } T;\nint f(void) { struct x *p = 0; return !p; }\nenum { ONE, TWO };\n")["symbols"]}
    assert {("STRUCT", "T", "DEFINITION"), ("TYPEDEF", "T", "DEFINITION"), ("STRUCT", "x", "DECLARATION"), ("ENUM", "TWO", "DEFINITION"), ("FUNCTION", "f", "DEFINITION")} == got


def test_only_the_faulty_unit_falls_back():
    text = "int good(void)\n{\n  return 1;\n}\n\nint bad(int x {\n  return x;\n}\n\nint fine(void)\n{\n  return 2;\n}\n"
    got = st.parse(text, ".c")
    assert got["outcome"] == "FALLBACK_SUCCESS" and got["fallback_reason"] == "syntax_error_or_missing_node"
    assert [s["kind"] for s in got["spans"]] == ["FUNCTION", "LINE_WINDOW", "FUNCTION"] and got["spans"][1]["split_mode"] == "DIAGNOSTIC_FALLBACK"
    assert got["spans"][-1]["end"] == len(text) and all(a["end"] == b["start"] for a, b in zip(got["spans"], got["spans"][1:]))
    assert {s["name"] for s in st.extract(text)["symbols"]} == {"good", "fine"}


def test_grammar_by_least_score():
    for text, ext, want in (("namespace a { class B { int x; }; }\n", ".h", "cpp"), ("int f(void);\n", ".h", "c"), ("int f(void);\n", ".cpp", "cpp"), ("class X;\n", ".c", "c")):
        got = st.parse(text, ext)
        assert got["language"] == want, (text, ext)
        assert len(got["attempts"]) == (2 if ext == ".h" else 1)
    assert st.parse("class X;\n", ".c")["outcome"] == "FALLBACK_SUCCESS"


def test_transparent_text_goes_to_the_next_unit():
    text = "#ifndef G\n#define G\n#if A\nint a(void) { return 1; }\n#else\nint b(void) { return 2; }\n#endif\n#endif\n"
    spans = st.parse(text, ".c")["spans"]
    assert [text[s["start"] : s["end"]] for s in spans] == ["#ifndef G\n#define G", "\n#if A\nint a(void) { return 1; }", "\n#else\nint b(void) { return 2; }\n#endif\n#endif\n"]
    assert [s["kind"] for s in spans] == ["MACRO", "FUNCTION", "FUNCTION"]


def test_large_units_split_by_their_parts():
    body = "".join(f"  if (a{i}) {{\n    call_{i}(x, y);\n  }} else {{\n    z = {i};\n  }}\n" for i in range(120))
    got = st.parse(f"int f(void)\n{{\n{body}}}\nenum e {{ {', '.join(f'VALUE_{i} = {i}' for i in range(400))} }};\n", ".c")
    fragments = [s for s in got["spans"] if s["parent"] == "FUNCTION"]
    assert len(fragments) >= 3 and all(s["end"] - s["start"] <= 3000 and s["split_mode"] in ("COALESCED_WITHIN_UNIT", "AST_CHILD") for s in fragments)
    assert {s["unit"] for s in fragments} == {(0, fragments[-1]["end"])}
    assert any(s["parent"] == "TYPE" and s["kind"] == "AST_BLOCK" for s in got["spans"])


def test_facts_have_all_counters():
    got = st.extract("int f(int *p, int n) {\n do { n--; } while (n);\n long v = (long) n; double d = (double)(n + 1);\n g((char *) p); if (n ? p[0] : *p) goto out;\n p->q.r += sizeof(int);\nout: return (n);\n}\n")
    (f,) = [s for s in got["symbols"] if s["symbol_kind"] == "FUNCTION"]
    assert f["facts"] == {"array_accesses": 1, "assignments": 3, "calls": 1, "casts": 3, "conditions": 2, "field_accesses": 2, "gotos": 1, "loops": 1, "pointer_operations": 1, "returns": 1, "sizeof_expressions": 1, "updates": 1}
    assert len(got["facts"]) == sum(f["facts"].values())
