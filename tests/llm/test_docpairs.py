import pytest

from lodestrata.llm.docpairs import DocParams, description_of, documented_functions, function_pairs, functions_of

P = DocParams()
SAID = "Merges two lists without losing their order."


def names(code, language):
    return [n for n, _, _ in functions_of(code, language)]


def documented(code, language, node="class", ident=None, doc=None):
    return {n for n, _, _ in documented_functions(code, language, node, ident, doc, P)}


def test_rust():
    code = f'impl A {{\n    /// {SAID}\n    #[must_use]\n    pub fn a(&self) -> X {{ let s = "}} fn no() {{"; s }}\n\n    // {SAID}\n    fn b() {{ if x {{ y() }} }}\n    #[doc = "{SAID}"]\n    async fn c<\'a>(x: &\'a str) {{}}\n    /** {SAID} */\n    fn d() {{ \'{{\' }}\n}}'
    assert names(code, "rust") == ["a", "b", "c", "d"]
    assert documented(code, "rust") == {"a", "c", "d"}


def test_typescript():
    code = f"class A {{\n  /**\n   * {SAID}\n   * @param x the x\n   */\n  async a(x: B): Promise<C> {{\n    return `}}${{x}}`;\n  }}\n\n  // {SAID}\n  b() {{ while (x) {{ y(); }} }}\n}}\n/** {SAID} */\nexport const c = (x: number): number => {{ return x; }};\n/** {SAID} */\nfunction d() {{}}"
    assert names(code, "typescript") == ["a", "b", "c", "d"]
    assert documented(code, "typescript") == {"a", "c", "d"}


def test_python():
    code = f'class A:\n    # {SAID}\n    def a(self):\n        x = """def no(): pass"""\n        return x\n\n    @staticmethod\n    async def b(x: int = len(")")) -> dict[str, int]:\n        r"""{SAID}\n\n        :returns: x\n        """\n        return x\n\n    def c(self): return 1\n'
    assert names(code, "python") == ["a", "b", "c"]
    assert documented(code, "python") == {"b"}


def test_go():
    code = f'// {SAID}\nfunc a() error {{\n\treturn nil\n}}\n\n// {SAID}\n\nfunc (s *S) b(x int) (int, error) {{\n\tgo func() {{ }}()\n}}\n/*\n{SAID}\n*/\nfunc c() {{ x := "func no() {{" }}\n'
    assert names(code, "go") == ["a", "b", "c"]
    assert documented(code, "go") == {"a", "c"}


@pytest.mark.parametrize("text", ["", "  ", "TODO", "TODO: document this properly in the next release", "n/a", "...", "-----", "WIP", "merge lists", "The mergeLists function.", "Summary of mergeLists", "@param a\n@returns", ":param a: the first list of all\n:rtype: X", "# Examples", "See above.", "Auto-generated method stub", "Insert description here.", "Method stub, generated by the editor.", "Docstring for mergeLists.", "FIXME: describe what this does once there is time", None])
def test_trivial(text):
    assert description_of(text, "mergeLists", P) is None


@pytest.mark.parametrize("text", [SAID, "Collects every TODO marker left in the parsed node.", "Gibt den Puffer zurück, sobald der Index bereit ist.", "リストを順序どおりに結合して返します。", f"{SAID}\n@returns the list"])
def test_real(text):
    assert description_of(text, "mergeLists", P)


def test_docstring_column_counts_for_functions_only():
    assert documented("fn a() {}", "rust", "function_item", "a", SAID) == {"a"}
    assert documented("impl A {}", "rust", "impl_item", "A", SAID) == set()
    assert documented(None, None, "function_item", "a", SAID) == {"a"}
    assert documented(None, "rust", "function_item", "a", SAID) == set()
    assert documented("fn b() {}", "rust", "function_item", "a", SAID) == set()
    assert documented_functions("let x = 1; fn a() { y }", "rust", "function_item", "a", SAID, P) == [("a", SAID, "fn a() { y }")]
    assert documented(f"/// {SAID}\nfn a() {{}}", "rust", "function_item", "a", "TODO") == {"a"}


def test_functions_of_one_name_each_have_a_row():
    code = f"impl A {{\n    /// {SAID}\n    fn new() {{ 1 }}\n}}\nimpl B {{\n    /// Makes an empty one of the other kind.\n    fn new() {{ 2 }}\n}}"
    assert [n for n, _, _ in documented_functions(code, "rust", "impl_item", "A", None, P)] == ["new", "new"]


def test_texts_of_several_mb_are_read_to_their_end():
    one = f'    pub fn a() {{ let s = "}}"; s.map(|x| {{ x + 1 }}) }}\n'
    code = one * (16_000_000 // len(one)) + f"/// {SAID}\nfn last() {{}}\n"
    assert documented(code, "rust") == {"last"}


@pytest.mark.parametrize(("language", "comment", "last"), [("rust", f"/// {SAID}\n", "fn last() {}"), ("typescript", f"/** {SAID} */\n", "function last() {}"), ("go", f"// {SAID}\n", "func last() {}")])
def test_long_runs_of_comments_before_something_else(language, comment, last):
    code = comment * 40_000 + f"type A = 1;\n{comment}{last}\n"
    assert documented(code, language) == {"last"}


def test_table(spark):
    schema = "chunk_id string, language string, node_type string, identifier string, docstring string, code_content string, function_name string, code int"
    rows = [("a", "go", "function_declaration", "f", None, f"// {SAID}\nfunc f() {{}}", "x", 1), ("n", None, None, None, None, None, "x", 1), (None, "go", "function_declaration", "f", SAID, "func f() {}", "x", 1), ("l", "rust", "function_item", "g", SAID, "fn g() {" + "x();" * 40000 + "}", "x", 1)]
    df = spark.createDataFrame(rows, schema)
    assert {(r.chunk_id, r.function_name) for r in function_pairs(df).collect()} == {("a", "f"), ("l", "g")}
    assert function_pairs(df.limit(0)).count() == 0
