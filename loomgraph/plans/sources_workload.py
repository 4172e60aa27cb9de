"""Source files made from the given parts, and what they contain, in Spark and in SQL.

Part k is a file of one of four languages. Its text is a template with k in its names, after as many
empty lines as its size says; every fiftieth file is no text at all. What a template contains is
stated below by hand, and the SQL twins derive their rows from that statement alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.workload import table

LANGUAGES = ("Python", "TypeScript", "JavaScript", "Rust")
SUFFIXES = ("py", "ts", "js", "rs")

TEMPLATES = {
    "Python": """import os
class Base{k}(Parent{k}):
    def method_{k}(self, arg: Kind{k}, n: int) -> Result{k}:
        helper_{k}(n)
        self.part.call_{k}(arg)
        from .mod{k} import thing
def _private_{k}(x: Item{k}): pass
async def co_{k}():
    import pack{k}.sub as alias
print "no longer a statement", old{k}()""",
    "TypeScript": """import { a } from './mod{k}';
export class Foo{k} extends Bar{k} {
  run{k}(x: Kind{k}): Result{k} { go{k}(); this.other{k}(); }
}
interface Shape{k} { size: Unit{k} }
type Alias{k} = string | Other{k};
enum Color{k} { Red, Green }
export function greet{k}(n: string): void { load{k}('x'); }
const add{k} = (a: number) => a + 1;
const text{k} = (b: Item{k}) => `${ask{k}(`{${deep{k}(b)}}`)} and { not${`it`}s`;""",
    "JavaScript": """const one{k} = function(a) { return two{k}(a); }
class Foo{k} extends Bar{k} { run{k}() { this.go{k}(); } }
function* gen{k}() { yield 1; }
async function co{k}() { import x from 'pack{k}'; }""",
    "Rust": """use std::io::Read{k};
pub struct Foo{k} { a: Kind{k} }
impl Show{k} for Foo{k} { fn fmt{k}(&self) { self.go{k}(); make{k}(); } }
pub(crate) fn f{k}(x: u8) -> Out{k} { path::g{k}(); }
pub(super) fn h{k}() {}
mod inner{k} { use std::Thing{k}; }
const MAX{k}: u32 = 3;
type Short{k} = Vec<u8>;
trait Trait{k} { fn a(&self); }
enum Either{k} { A, B }
fn life{k}<'a>(x: &'a str, c: char) -> &'a str { if c == 'x' || c == '\\'' { born{k}() } }
impl<'a> Hold{k}<'a> { fn get{k}(&'a self) -> Got{k} { keep{k}() } }""",
}

#: kind, name, visibility, first line, last line, signature, name and line of the block around.
BLOCKS = {
    "Python": [
        ("Class", "Base{k}", "Public", 2, 6, "class Base{k}(Parent{k}):", None, None),
        ("Function", "method_{k}", "Public", 3, 6, "def method_{k}(self, arg: Kind{k}, n: int) -> Result{k}:", "Base{k}", 2),
        ("Function", "_private_{k}", "Private", 7, 7, "def _private_{k}(x: Item{k}): pass", None, None),
        ("Function", "co_{k}", "Public", 8, 9, "async def co_{k}():", None, None),
    ],
    "TypeScript": [
        ("Class", "Foo{k}", "Public", 2, 4, "class Foo{k} extends Bar{k} {", None, None),
        ("Function", "run{k}", "Public", 3, 3, "run{k}(x: Kind{k}): Result{k} { go{k}(); this.other{k}(); }", "Foo{k}", 2),
        ("Interface", "Shape{k}", "Public", 5, 5, "interface Shape{k} { size: Unit{k} }", None, None),
        ("TypeAlias", "Alias{k}", "Public", 6, 6, "type Alias{k} = string | Other{k};", None, None),
        ("Enum", "Color{k}", "Public", 7, 7, "enum Color{k} { Red, Green }", None, None),
        ("Function", "greet{k}", "Public", 8, 8, "function greet{k}(n: string): void { load{k}('x'); }", None, None),
        ("Function", "add{k}", "Public", 9, 9, "(a: number) => a + 1", None, None),
        ("Function", "text{k}", "Public", 10, 10, "(b: Item{k}) => `${ask{k}(`{${deep{k}(b)}}`)} and { not${`it`}s`", None, None),
    ],
    "JavaScript": [
        ("Function", "one{k}", "Public", 1, 1, "function(a) { return two{k}(a); }", None, None),
        ("Class", "Foo{k}", "Public", 2, 2, "class Foo{k} extends Bar{k} { run{k}() { this.go{k}(); } }", None, None),
        ("Function", "run{k}", "Public", 2, 2, "run{k}() { this.go{k}(); }", "Foo{k}", 2),
        ("Function", "gen{k}", "Public", 3, 3, "function* gen{k}() { yield 1; }", None, None),
        ("Function", "co{k}", "Public", 4, 4, "async function co{k}() { import x from 'pack{k}'; }", None, None),
    ],
    "Rust": [
        ("Struct", "Foo{k}", "Public", 2, 2, "pub struct Foo{k} { a: Kind{k} }", None, None),
        ("Impl", "Show{k} for Foo{k}", "Private", 3, 3, "impl Show{k} for Foo{k} { fn fmt{k}(&self) { self.go{k}(); make{k}(); } }", None, None),
        ("Function", "fmt{k}", "Private", 3, 3, "fn fmt{k}(&self) { self.go{k}(); make{k}(); }", "Show{k} for Foo{k}", 3),
        ("Function", "f{k}", "Crate", 4, 4, "pub(crate) fn f{k}(x: u8) -> Out{k} { path::g{k}(); }", None, None),
        ("Function", "h{k}", "Protected", 5, 5, "pub(super) fn h{k}() {}", None, None),
        ("Module", "inner{k}", "Private", 6, 6, "mod inner{k} { use std::Thing{k}; }", None, None),
        ("Constant", "MAX{k}", "Private", 7, 7, "const MAX{k}: u32 = 3;", None, None),
        ("TypeAlias", "Short{k}", "Private", 8, 8, "type Short{k} = Vec<u8>;", None, None),
        ("Trait", "Trait{k}", "Private", 9, 9, "trait Trait{k} { fn a(&self); }", None, None),
        ("Enum", "Either{k}", "Private", 10, 10, "enum Either{k} { A, B }", None, None),
        ("Function", "life{k}", "Private", 11, 11, "fn life{k}<'a>(x: &'a str, c: char) -> &'a str { if c == 'x' || c == '\\'' { born{k}() } }", None, None),
        ("Impl", "impl Hold{k}<'a>", "Private", 12, 12, "impl<'a> Hold{k}<'a> { fn get{k}(&'a self) -> Got{k} { keep{k}() } }", None, None),
        ("Function", "get{k}", "Private", 12, 12, "fn get{k}(&'a self) -> Got{k} { keep{k}() }", "impl Hold{k}<'a>", 12),
    ],
}

#: kind, name, module path, and names and first lines of the blocks around.
REFERENCES = {
    "Python": [
        ("Inheritance", "Parent{k}", None, [("Base{k}", 2)]),
        ("TypeReference", "Kind{k}", None, [("Base{k}", 2), ("method_{k}", 3)]),
        ("TypeReference", "Result{k}", None, [("Base{k}", 2), ("method_{k}", 3)]),
        ("FunctionCall", "helper_{k}", None, [("Base{k}", 2), ("method_{k}", 3)]),
        ("MethodCall", "call_{k}", None, [("Base{k}", 2), ("method_{k}", 3)]),
        ("Import", ".mod{k}", ".mod{k}", [("Base{k}", 2), ("method_{k}", 3)]),
        ("TypeReference", "Item{k}", None, [("_private_{k}", 7)]),
        ("Import", "pack{k}.sub as alias", "pack{k}.sub as alias", [("co_{k}", 8)]),
    ],
    "TypeScript": [
        ("TypeReference", "Foo{k}", None, [("Foo{k}", 2)]),
        ("Inheritance", "Bar{k}", None, [("Foo{k}", 2)]),
        ("TypeReference", "Kind{k}", None, [("Foo{k}", 2), ("run{k}", 3)]),
        ("TypeReference", "Result{k}", None, [("Foo{k}", 2), ("run{k}", 3)]),
        ("FunctionCall", "go{k}", None, [("Foo{k}", 2), ("run{k}", 3)]),
        ("MethodCall", "other{k}", None, [("Foo{k}", 2), ("run{k}", 3)]),
        ("TypeReference", "Shape{k}", None, [("Shape{k}", 5)]),
        ("TypeReference", "Unit{k}", None, [("Shape{k}", 5)]),
        ("TypeReference", "Alias{k}", None, [("Alias{k}", 6)]),
        ("TypeReference", "Other{k}", None, [("Alias{k}", 6)]),
        ("FunctionCall", "load{k}", None, [("greet{k}", 8)]),
        ("TypeReference", "Item{k}", None, [("text{k}", 10)]),
        ("FunctionCall", "ask{k}", None, [("text{k}", 10)]),
        ("FunctionCall", "deep{k}", None, [("text{k}", 10)]),
    ],
    "JavaScript": [
        ("FunctionCall", "two{k}", None, [("one{k}", 1)]),
        ("MethodCall", "go{k}", None, [("Foo{k}", 2), ("run{k}", 2)]),
        ("Import", "pack{k}", "pack{k}", [("co{k}", 4)]),
    ],
    "Rust": [
        ("TypeReference", "Foo{k}", None, [("Foo{k}", 2)]),
        ("TypeReference", "Kind{k}", None, [("Foo{k}", 2)]),
        ("TraitImpl", "Show{k}", None, [("Show{k} for Foo{k}", 3)]),
        ("TypeReference", "Show{k}", None, [("Show{k} for Foo{k}", 3)]),
        ("TypeReference", "Foo{k}", None, [("Show{k} for Foo{k}", 3)]),
        ("MethodCall", "go{k}", None, [("Show{k} for Foo{k}", 3), ("fmt{k}", 3)]),
        ("FunctionCall", "make{k}", None, [("Show{k} for Foo{k}", 3), ("fmt{k}", 3)]),
        ("TypeReference", "Out{k}", None, [("f{k}", 4)]),
        ("FunctionCall", "g{k}", None, [("f{k}", 4)]),
        ("Import", "Thing{k}", "Thing{k}", [("inner{k}", 6)]),
        ("TypeReference", "Short{k}", None, [("Short{k}", 8)]),
        ("TypeReference", "Vec", None, [("Short{k}", 8)]),
        ("TypeReference", "Trait{k}", None, [("Trait{k}", 9)]),
        ("TypeReference", "Either{k}", None, [("Either{k}", 10)]),
        ("FunctionCall", "born{k}", None, [("life{k}", 11)]),
        ("TypeReference", "Hold{k}", None, [("impl Hold{k}<'a>", 12)]),
        ("TypeReference", "Got{k}", None, [("impl Hold{k}<'a>", 12), ("get{k}", 12)]),
        ("FunctionCall", "keep{k}", None, [("impl Hold{k}<'a>", 12), ("get{k}", 12)]),
    ],
}


def source_files(spark: SparkSession, d: str, language: str | None = None) -> DataFrame:
    """path, language, content of the files of one language, or of all.

    A part is a few bytes and its file takes a millisecond to read, so parts are dealt to tasks by their number, not by
    their bytes; a task has them in an order that a repetition keeps.
    """
    k = F.col("p_partkey").cast("string")
    turn = F.col("p_partkey") % len(LANGUAGES)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (turn + 1).cast("int"))
    template = pick([TEMPLATES[name] for name in LANGUAGES])
    lines = F.concat(F.repeat(F.lit("\n"), (F.col("p_size") % 5).cast("int")), F.replace(template, F.lit("{k}"), k))
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    if language is not None:
        parts = parts.filter(turn == LANGUAGES.index(language))
    n_tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = parts.repartition(n_tasks, "p_partkey").sortWithinPartitions("p_partkey", "p_size")
    return dealt.select(
        F.concat(F.lit("src/p"), k, F.lit("."), pick(SUFFIXES)).alias("path"),
        pick(LANGUAGES).alias("language"),
        F.when(F.col("p_partkey") % 50 == 0, F.unhex(F.lit("FFFE"))).otherwise(lines.cast("binary")).alias("content"),
    )


SOURCE_FILES = f"""files AS (SELECT p_partkey AS k, CAST(p_size % 5 AS INTEGER) AS shift, p_partkey % 50 = 0 AS broken,
  {list(LANGUAGES)}[CAST(p_partkey % 4 AS INTEGER) + 1] AS language,
  'src/p' || p_partkey || '.' || {list(SUFFIXES)}[CAST(p_partkey % 4 AS INTEGER) + 1] AS path FROM part)"""


def _quoted(value: str | int | None) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(map(_quoted, r))})" for r in rows)


def blocks_sql(language: str) -> str:
    named = lambda c: f"replace({c}, '{{k}}', CAST(k AS VARCHAR))"
    return f"""WITH {SOURCE_FILES},
    stated(kind, name, visibility, first, last, signature, outer_name, outer_line) AS (VALUES {_values(BLOCKS[language])})
    SELECT path || '::' || {named('name')} || '@' || (first + shift) AS id, kind, {named('name')} AS name, visibility,
      {named('signature')} AS signature, CAST(first + shift AS INTEGER) AS start_line, CAST(last + shift AS INTEGER) AS end_line,
      coalesce(path || '::' || {named('outer_name')} || '@' || (outer_line + shift), path) AS parent_id, path AS file_path
    FROM files CROSS JOIN stated WHERE language = '{language}' AND NOT broken"""


def references_sql(language: str) -> str:
    named = lambda c: f"replace({c}, '{{k}}', CAST(k AS VARCHAR))"
    rows = [(kind, name, module, *block) for kind, name, module, around in REFERENCES[language] for block in around]
    return f"""WITH {SOURCE_FILES}, stated(kind, name, module, outer_name, outer_line) AS (VALUES {_values(rows)})
    SELECT path || '::' || {named('outer_name')} || '@' || (outer_line + shift) AS from_node, kind, {named('name')} AS name,
      CAST({named('module')} AS VARCHAR) AS module_path, path AS file_path
    FROM files CROSS JOIN stated WHERE language = '{language}' AND NOT broken"""


def results_sql() -> str:
    counts = _values([(name, len(BLOCKS[name])) for name in LANGUAGES])
    return f"""WITH {SOURCE_FILES}, stated(language, n) AS (VALUES {counts})
    SELECT path, CASE WHEN NOT broken THEN CAST(n AS BIGINT) END AS blocks, broken AS failed,
      CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS seq
    FROM files JOIN stated USING (language)"""
