import pytest
from pyspark.sql import functions as F

from corvane.functions import languages
from corvane.operators import embed, evaluate, lookup, models, rollups, rules, syntax, vault
from corvane.sources import banks

GO = 'package x\n\n// Keep keeps.\nfunc (s *A) Keep(x int) error {\n\tif s := "}"; s != "" {\n\t}\n\treturn nil\n}\n\ntype A struct {\n}\n'
RS = "/// Joins.\n#[inline]\npub fn join<'a>(x: &'a str) -> u64 {\n    let c = '{';\n    1\n}\nimpl Show for A {\n    fn show(&self) {}\n}\n"
TS = "/* function no() { } */\nexport class A {\n  // Runs.\n  async run(x: number): Promise<void> {\n    if (x) { go(); }\n  }\n}\nconst f = (a) => {\n  return a;\n};\n"

WIDE_TS = '\nimport x from "y";\nconst re = /[{"]\\\\/}/g;\nconst s = `a ${b ? `c { ${d}` : "}"} e`;\n// Runs it.\nexport default async function* gen(a, {b, c} = {}) { return a / b / c; }\nfunction over(a: string): void;\nfunction over(a: { x: number }): { y: string } { const inner = () => { function deep() {} }; return { y: "" }; }\nexport abstract class A<T extends {a: 1}> extends B.C<T> implements D {\n  x = () => { foo(); };\n  private readonly y: number = 3;\n  constructor(private z: string) { super(); }\n  get v(): number { return 1 }\n  static async *[Symbol.iterator]() { }\n  abstract m(): void;\n  #hid<T>(a: T): T { if (a) { call(a); } return a; }\n}\ninterface I extends J { a(): void }\nexport type U =\n  | { kind: "a" }\n  | { kind: "b" };\ntype V = string\nconst f = async <T,>(a: T): Promise<T> => {\n  return a;\n};\nexport const g = (a) => a + 1;\nconst o = { run() { return 1; }, go: function () { }, h: (x) => x };\nenum E { A, B }\n'
WIDE_GO = 'package p\n// Keep keeps.\nfunc (s *A[T]) Keep(x int, f func() error) (int, error) {\n\tif s := `}"`; s != "" { }\n\treturn 0, nil\n}\nfunc Gen[T any](m map[string]struct{}) map[string]struct{} { return m }\nfunc ext(a int) int\ntype A struct {\n\tx int\n}\ntype (\n\tB int\n\tC interface{ Do() }\n)\ntype D = map[string]int\nvar v = func() { }\n'
WIDE_RS = '/// Joins.\n#[inline]\npub(crate) async unsafe fn join<\'a, T: Into<String>>(x: &\'a str, c: char) -> Result<impl Fn() -> u8, E> where T: X {\n    let c = \'{\'; let r = r#"}"#; /* a /* b */ } */\n    fn nested() {}\n    1\n}\npub struct P(u8, u8);\nstruct Q<T> { a: T }\npub enum E { A { x: u8 }, B }\nunsafe trait T: Send { fn sig(&self); fn def(&self) -> u8 { 1 } }\nimpl<\'a, T> fmt::Display for Wrap<\'a, T> where T: X {\n    fn fmt(&self) {}\n}\nimpl Plain { }\nextern "C" fn ext(a: u8) -> u8 { a }\n'
WIDE_SC = 'package a\nobject Main extends App {\n  // Adds.\n  override def add(a: Int)(implicit b: B): Int = {\n    val x = s"${a} }"\n    a\n  }\n  def short(x: Int) = x + 1\n  def abs(x: Int): Int\n  private[pkg] def multi(x: Int): Int =\n    x match {\n      case 1 => 2\n    }\n  def `odd name` = 1\n}\ncase class P(a: Int, b: String)\nsealed trait T { def m: Int }\nclass Q(x: Int) extends P(1, "{") with T {\n  val c = \'{\'\n}\n'


def test_definitions_with_braces():
    told = lambda t, lang: [(a, b, k, s) for a, b, k, s, _ in syntax.brace_nodes(t, lang)]
    assert told(GO, "go") == [(4, 8, "method_declaration", "Keep"), (10, 11, "type_declaration", "A")]
    assert told(RS, "rust") == [(3, 6, "function_item", "join"), (7, 9, "impl_item", "A"), (8, 8, "function_item", "show")]
    assert told(TS, "typescript") == [(2, 7, "class_declaration", "A"), (4, 6, "method_definition", "run"), (8, 10, "variable_declarator", "f")]
    assert syntax.brace_nodes(GO, "go")[0][4] == "// Keep keeps." and syntax.brace_nodes(RS, "rust")[0][4] == "/// Joins."
    assert syntax.brace_nodes(None, "go") is None and syntax.brace_nodes("x", "cobol") is None and syntax.brace_nodes("", "go") == []


def test_declarations_of_wide_samples():
    told = lambda t, lang: [x[:4] for x in syntax.brace_nodes(t, lang)]
    assert told(WIDE_TS, 'typescript') == [(6, 6, 'generator_function_declaration', 'gen'), (7, 7, 'function_declaration', 'over'), (8, 8, 'function_declaration', 'over'), (8, 8, 'function_declaration', 'deep'), (9, 17, 'abstract_class_declaration', 'A'), (12, 12, 'method_definition', 'constructor'), (13, 13, 'method_definition', 'v'), (16, 16, 'method_definition', '#hid'), (18, 18, 'interface_declaration', 'I'), (19, 21, 'type_alias_declaration', 'U'), (22, 22, 'type_alias_declaration', 'V'), (23, 25, 'variable_declarator', 'f'), (26, 26, 'variable_declarator', 'g'), (27, 27, 'method_definition', 'run')]
    assert told(WIDE_GO, 'go') == [(3, 6, 'method_declaration', 'Keep'), (7, 7, 'function_declaration', 'Gen'), (9, 11, 'type_declaration', 'A'), (12, 15, 'type_declaration', 'B'), (16, 16, 'type_declaration', 'D')]
    assert told(WIDE_RS, 'rust') == [(3, 7, 'function_item', 'join'), (5, 5, 'function_item', 'nested'), (8, 8, 'struct_item', 'P'), (9, 9, 'struct_item', 'Q'), (10, 10, 'enum_item', 'E'), (11, 11, 'trait_item', 'T'), (11, 11, 'function_item', 'def'), (12, 14, 'impl_item', 'Wrap'), (13, 13, 'function_item', 'fmt'), (15, 15, 'impl_item', 'Plain'), (16, 16, 'function_item', 'ext')]
    assert told(WIDE_SC, 'scala') == [(2, 15, 'object_definition', 'Main'), (4, 7, 'function_definition', 'add'), (8, 8, 'function_definition', 'short'), (9, 9, 'function_declaration', 'abs'), (10, 13, 'function_definition', 'multi'), (14, 14, 'function_definition', 'odd name'), (16, 16, 'class_definition', 'P'), (17, 17, 'trait_definition', 'T'), (17, 17, 'function_declaration', 'm'), (18, 20, 'class_definition', 'Q')]
    assert all(syntax.brace_nodes(WIDE_TS[:k], "typescript") is not None for k in range(0, len(WIDE_TS), 7))
    assert [x[4] for x in syntax.brace_nodes(WIDE_RS, "rust")][:2] == ["/// Joins.", ""]
    assert syntax.brace_nodes("((((" * 20_000, "go") == [] and syntax.brace_nodes("a < b; " * 20_000, "typescript") == []


def test_languages(spark):
    assert [languages.of_name(n) for n in ("a.py", "b.tsx", "c.json", "d.md", "Makefile", "x.unknown", "", "e.sh")] == ["python", "tsx", None, None, "make", None, None, "shell"]
    df = spark.createDataFrame([("a/b.rs",), (None,), ("",)], "p string")
    assert [r[0] for r in df.select(languages.language_of_path(F.col("p"))).collect()] == ["rust", None, None]
    diffs = spark.createDataFrame([("+++ b/x.py",), ("+++ b/readme.md\n+++ b/src/x.go\n",), ("",), (None,)], "d string")
    assert [r[0] for r in diffs.select(languages.language_of_diff(F.col("d"))).collect()] == ["python", "go", None, None]


def test_one_scope(spark):
    t = spark.createDataFrame([(1, "user", "me"), (2, "org", "us"), (3, "org", "them")], "id int, kind string, name string")
    assert lookup.one_scope(t, id=2).name == "us" and lookup.one_scope(t, name="no") is None
    with pytest.raises(lookup.Ambiguous):
        lookup.one_scope(t, kind="org")


def test_promotion_and_pushes(spark):
    c = spark.createDataFrame([(1, None, "s", '{"node_kind":"n","symbol_name":"x"}'), (2, None, None, "{cut")], "id int, node_kind string, symbol_name string, context_json string")
    assert [(r.node_kind, r.symbol_name) for r in lookup.promoted(c).orderBy("id").collect()] == [("n", "s"), (None, None)]
    repos = spark.createDataFrame([("a", "1"), ("b", None)], "full_name string, pushed_at string")
    new = spark.createDataFrame([("a", "2"), ("a", "3"), ("c", "9")], "full_name string, pushed_at string")
    assert {r.full_name: r.pushed_at for r in lookup.with_pushed(repos, new).collect()} == {"a": "3", "b": None}


BANK = "queries:\n- query: where\n  tool: find_code\n  tier: 1\n  expect_any: [{path_substr: a.py}]\n  filters: {language: python}\n"


def test_banks_are_checked(spark):
    (entry,) = banks.parse_bank(BANK)
    assert banks.filters_of(entry).kind == "file" and banks.filters_of(entry).language == "python"
    assert banks.bank_table(spark, [entry]).first().label == "where"
    for bad in ("x", BANK.replace("tier: 1", "tier: 9"), BANK.replace("find_code", "no"), BANK.replace("path_substr", "no"), BANK.replace("language", "no"), BANK.replace("query:", "ask:"), BANK.replace("[{path_substr: a.py}]", "[]")):
        with pytest.raises(ValueError):
            banks.parse_bank(bad)


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert models.retried(call, sleep=waits.append) == "done" and len(waits) == 2 and waits[0] < waits[1] * 1.5
    with pytest.raises(OSError):
        models.retried(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)


def test_review_distances(spark):
    # A class within the test goes to the workers by value.
    class Says:
        def __init__(self, word):
            self.word = word

        def say(self, prompt):
            if prompt == "bad":
                raise RuntimeError
            return self.word

    df = spark.createDataFrame([(1, "h", "good words"), (2, "bad", "x")], "chunk_id long, diff_hunk string, truth_comment string")
    got = models.review_distances(df, Says("else"), Says("good words"), embed.HashEmbedder(32)).collect()
    assert [(r.chunk_id, round(r.informed, 6)) for r in got] == [(1, 0.0)] and got[0].baseline > 0.5
    assert evaluate.paired_t(models.review_distances(df, Says("a"), Says("b"), embed.HashEmbedder(8)), "baseline", "informed") == (None, None)


def test_distilling(spark):
    rows = [("s", k, [1.0, 0.01 * k]) for k in range(4)] + [("s", 10 + k, [0.01 * k, 1.0]) for k in range(4)]
    points = spark.createDataFrame(rows, "scope string, chunk_id long, embedding array<float>")
    chunks = spark.createDataFrame([(k, k, f"text {k}", "go", "review_comment") for _, k, _ in rows], "id long, artifact_id long, text string, language string, kind string")
    artifacts = spark.createDataFrame([(k, "r", "u", "a", 1) for _, k, _ in rows], "id long, repo string, source_url string, author_login string, target_id int")
    a, c = models.distilled(points, chunks, artifacts, models.FirstText(), 7)
    assert {r.external_id for r in a.collect()} == {r.external_id for r in c.collect()} and a.count() == 2 and all(r.language == "go" for r in c.collect())
    assert {r.external_id for r in models.distilled(points, chunks, artifacts, models.FirstText(), 7)[0].collect()} == {r.external_id for r in a.collect()}
    assert models.cluster_review_comments(chunks, artifacts, points.drop("scope"), author="a").count() > 0
    assert models.cluster_code_chunks(chunks, artifacts, points.drop("scope")).count() == 0


def test_pages_are_exported(spark, data, tmp_path):
    read = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    pages = vault.rule_pages(rules.list_rules(read("chunk"), read("artifact"))).unionByName(vault.file_pages(read("chunk"), read("artifact"))).unionByName(vault.repo_pages(rollups.repo_overview(read("repo"), read("artifact"), read("chunk"))))
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "old.md").write_text("x")
    have = spark.createDataFrame([("rules/old.md", "x", True), ("mine.md", "y", False)], "path string, text string, generated boolean")
    acts = {r.path: r.action for r in vault.export(pages, have, str(tmp_path)).collect()}
    assert acts["rules/old.md"] == "removed" and acts["mine.md"] == "adopted" and not (tmp_path / "rules" / "old.md").exists()
    for row in pages.limit(5).collect():
        assert (tmp_path / row.path).read_text() == row.text
