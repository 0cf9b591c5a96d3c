from lodestrata.llm.handwritten import DATA, GENERATED, MINIFIED, VENDORED, MiningParams, attribute_rules, evidence_of, glob_to_regex, not_handwritten
import re

SCHEMA = "file_path string, text string, kind int, path string, evidence int"


def flagged(spark, rows, attributes=None, params=None):
    chunks = spark.createDataFrame([(p, t, 1, "x", 0) for p, t in rows], SCHEMA)
    att = spark.createDataFrame(attributes, "path string, content string") if attributes else None
    return {r.file_path: r.kinds for r in not_handwritten(chunks, "file_path", "text", att, params).collect()}


def test_headers():
    assert evidence_of("// Code generated by x from y; DO NOT EDIT.\n\nfunc a() {}") == GENERATED
    assert evidence_of("# <auto-generated> tool 3 </auto-generated>\nx = 1") == GENERATED
    assert evidence_of("// Vendored copy of libfoo 1.2, taken over from upstream.\nfn a() {}") == VENDORED
    assert evidence_of("// From foo-1.2.tar.gz; local patches are listed in PATCHES.\n") == VENDORED
    assert evidence_of("// writes the line 'DO NOT EDIT' on top of each generated file\nfn a() {}") == 0
    assert evidence_of("/** Auto-generated method stub */\nfunction a() {}") == 0
    assert evidence_of("# pays the vendor of the job\ndef a(): pass") == 0


def test_headers_after_long_licence_comments():
    licence = [f"Licence text, line {k}." for k in range(40)]
    mark = "Code generated by x from y; DO NOT EDIT."
    lined = "\n".join(f"// {x}" for x in licence)
    assert evidence_of(f"{lined}\n\n// {mark}\n\npackage a") == GENERATED
    assert evidence_of(f"{lined}\npackage a\n// {mark}\n") == 0
    assert evidence_of("/*\n * " + "\n * ".join([*licence, mark]) + "\n */\npackage a") == GENERATED
    plain = "/*\n" + "\n".join(licence) + "\n*/\n"
    assert evidence_of(f"{plain}// {mark}\npackage a") == GENERATED
    assert evidence_of(f"{plain}package a\n// {mark}\n") == 0
    assert evidence_of(f"/* a */ package a\n{mark}\n") == 0


def test_shapes():
    mini = "!function(t,e){" + "var n=v.filter||{},q=75092;k.a=function(z,p){return z?p.r(1):null};" * 8 + "}()"
    assert evidence_of(mini) == MINIFIED
    assert evidence_of("const s = " + repr("x y" * 300) + ";\nfunction a() { return s; }") == 0
    assert evidence_of("var T = []byte{\n" + "0x1b, 0x11, 0xc1, 0x7f, 0xbb, 0x47, 0xb9, 0x4a,\n" * 20 + "}") == DATA
    assert evidence_of(None) == evidence_of("") == 0


def test_globs_and_rules():
    ok = lambda g, p: bool(re.match(glob_to_regex(g), p))
    assert ok("*.rs", "a/b/c.rs") and ok("/x/*.rs", "x/c.rs") and not ok("/x/*.rs", "x/y/c.rs") and ok("lib/**", "lib/a/b") and ok("a/**/z", "a/z") and not ok("?.c", "ab.c")
    assert attribute_rules("p/.gitattributes", "# c\n*.js -linguist-vendored linguist-generated=true\n") == [("p", 1, glob_to_regex("*.js"), VENDORED, False), ("p", 1, glob_to_regex("*.js"), GENERATED, True)]


def test_attribute_files_take_precedence(spark):
    rows = [("p/vendor/a.rs", "fn a() {}"), ("p/src/b.rs", "fn b() {}"), ("p/src/deep/c.rs", "fn c() {}"), ("p/src/d.rs", "fn d() {}")]
    said = [("p/.gitattributes", "vendor/** -linguist-vendored\nsrc/** linguist-generated\nsrc/d.rs -linguist-generated"), ("p/src/deep/.gitattributes", "*.rs linguist-generated=false")]
    assert flagged(spark, rows) == {"p/vendor/a.rs": VENDORED}
    assert flagged(spark, rows, said) == {"p/src/b.rs": GENERATED}


def test_spelling_one_chunk_speaks_for_the_file_and_bad_rows(spark):
    rows = [("./p//gen\\a.go", "x"), ("p/src/a.go", "func a() {}"), ("p\\src\\a.go", "// Code generated by t. DO NOT EDIT.\n"), (None, "// @generated\n"), ("", "y"), ("p/src/n.go", None), ("p/vendor_payments/v.go", "func v() {}")]
    assert set(flagged(spark, rows + rows)) == {"./p//gen\\a.go", "p/src/a.go", "p\\src\\a.go"}
    assert flagged(spark, []) == {}


HEAD = "// Code generated by t from x.tpl. DO NOT EDIT.\n"
COPY = "// Vendored copy of libfoo 1.2, taken over from upstream.\n"


def test_patterns_are_mined(spark):
    rows = [(f"r{i}/odd_out/m{i}.rs", HEAD if i % 2 else "fn a() {}") for i in range(20)] + [(f"r{i}/src/m{i}.rs", "fn a() {}") for i in range(60)]
    odd = {p for p, _ in rows if "odd_out" in p}
    assert set(flagged(spark, rows)) == odd
    assert set(flagged(spark, rows, params=MiningParams(mine=False))) == {p for p, t in rows if t == HEAD}


def test_evidence_outweighs_conventions(spark):
    by_hand = [(f"r{i}/external/m{i}.rs", "fn a() {}") for i in range(40)]
    copied = [(f"r{i}/vendor/m{i}.rs", COPY if i % 6 == 0 else "fn a() {}") for i in range(400)] + [(f"r{i}/src/m{i}.rs", "fn a() {}") for i in range(900)]
    assert set(flagged(spark, by_hand[:5] + copied[-20:])) == {p for p, _ in by_hand[:5]}
    assert set(flagged(spark, by_hand + copied)) == {p for p, _ in copied if "/vendor/" in p}


def test_declared_files_teach_patterns_to_other_projects(spark):
    rows = [(f"p{i % 4}/lib/emitted/m{i}.rs", "fn a() {}") for i in range(24)] + [(f"p{i % 4}/src/m{i}.rs", "fn a() {}") for i in range(60)]
    said = [(f"p{k}/.gitattributes", "lib/emitted/** linguist-generated") for k in (0, 1)]
    assert set(flagged(spark, rows)) == set()
    assert set(flagged(spark, rows, said)) == {p for p, _ in rows if "emitted" in p}
    assert set(flagged(spark, rows, said, MiningParams(mine=False))) == {p for p, _ in rows if "emitted" in p and p[:2] in ("p0", "p1")}


def test_rules_hold_in_their_own_project_only(spark):
    chunks = spark.createDataFrame([("src/a.rs", "fn a() {}", "x"), ("src/b.rs", "fn b() {}", "y"), ("src/c.rs", "fn c() {}", None)], "file_path string, text string, project_name string")
    att = spark.createDataFrame([("x", ".gitattributes", "src/** linguist-generated")], "project string, path string, content string")
    assert {r.file_path for r in not_handwritten(chunks, "file_path", "text", att, project_col="project_name").collect()} == {"src/a.rs"}


def test_deep_paths_keep_all_their_directories(spark):
    deep = "/".join(f"d{k}" for k in range(150))
    rows = [(f"r/{deep}/odd_a/odd_b/m{i}.rs", HEAD if i < 6 else "fn a() {}") for i in range(12)] + [(f"r/src/m{i}.rs", "fn a() {}") for i in range(60)]
    assert len(flagged(spark, rows)) == 12
