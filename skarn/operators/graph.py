"""The property graph: vertex tables, and edge tables made by joins on natural keys.

All vertices exist before any edge is made, so edges don't depend on the order of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skarn.functions.exprs import non_empty

from . import relate
from .merge import latest

VERTEX_KEYS = {
    "functions": ["file", "name"], "variables": ["file", "name"], "types": ["file", "name"], "interfaces": ["file", "name"], "classes": ["file", "name"], "constants": ["file", "name"],
    "jsx_elements": ["file", "tag_name", "line"], "css_rules": ["file", "selector"], "references": ["source_file", "source_entity", "target_entity", "ref_type"],
}


class CodeGraph:
    """Vertices and edges over entity tables and their files (path, language)."""

    def __init__(self, tables: dict[str, DataFrame], files: DataFrame):
        self.files = latest(files.select("path", "language"), ["path"], ["language"])
        self.raw = tables
        self.vertices = {kind: latest(tables[kind], key, ["seq"]) for kind, key in VERTEX_KEYS.items()}
        self.vertices["imports"] = tables["imports"].select("module").distinct()

    def _ends(self, kind: str, name: str, edge: str) -> DataFrame:
        found = relate.belongs_to(self.vertices[kind], self.files, VERTEX_KEYS[kind][0], "path")
        return found.select(F.lit(edge).alias("edge"), F.lit(kind).alias("source_kind"), F.col(name).alias("source"), F.col("path").alias("target"))

    def belongs_to(self) -> DataFrame:
        """Functions, types, interfaces and classes of existing files."""
        return self._union(*[self._ends(k, "name", "BELONGS_TO") for k in ("functions", "types", "interfaces", "classes")])

    def defined_in(self) -> DataFrame:
        return self._union(self._ends("variables", "name", "DEFINED_IN"), self._ends("constants", "name", "DEFINED_IN"), self._ends("css_rules", "selector", "DEFINED_IN"))

    def used_in(self) -> DataFrame:
        return self._ends("jsx_elements", "tag_name", "USED_IN")

    def contains(self) -> DataFrame:
        return relate.belongs_to(self.vertices["references"], self.files, "source_file", "path").select(F.col("path").alias("file"), "source_entity", "target_entity", "ref_type", "line")

    @staticmethod
    def _union(*parts: DataFrame) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def imports(self, freeze: bool = False) -> DataFrame:
        """File -> module with the import's names; the last import of a pair wins, or the first with ``freeze``."""
        rows = self.raw["imports"].withColumn("_order", -F.col("seq") if freeze else F.col("seq"))
        return latest(rows, ["file", "module"], ["_order"]).drop("_order", "seq").join(self.files.select(F.col("path").alias("file")), "file", "left_semi")

    def renders(self) -> DataFrame:
        """The function that an element's component names, in the same file."""
        e = self.vertices["jsx_elements"].where(non_empty(F.col("containing_component")))
        f = self.vertices["functions"].select("file", F.col("name").alias("containing_component"))
        return e.join(f, ["file", "containing_component"]).select("file", F.col("containing_component").alias("component"), "tag_name", "line")

    def calls(self) -> DataFrame:
        """Resolved calls whose caller and target are functions: one edge for each pair, the last call's properties."""
        c = self.raw["function_calls"].where(non_empty(F.col("resolved_target")))
        f = self.vertices["functions"].select(F.col("file").alias("f_file"), F.col("name").alias("f_name"))
        caller = c.join(f, (F.col("caller_file") == F.col("f_file")) & (F.col("caller_func") == F.col("f_name")), "left_semi")
        both = caller.join(f, (F.col("target_file") == F.col("f_file")) & (F.col("resolved_target") == F.col("f_name")), "left_semi")
        return latest(both, ["caller_file", "caller_func", "target_file", "resolved_target"], ["seq"]).select("caller_file", "caller_func", "target_file", "resolved_target", "call_location", "call_context")

    def unlinked_calls(self) -> DataFrame:
        """Resolved calls from the top level, which have no caller vertex."""
        return self.raw["function_calls"].where(non_empty(F.col("resolved_target")) & ~non_empty(F.col("caller_func")))

    def unresolved_calls(self) -> DataFrame:
        rows = self.raw["function_calls"].where(~non_empty(F.col("resolved_target")))
        return latest(rows, ["called_func", "caller_file", "caller_func", "call_location"], ["seq"]).select("called_func", "caller_file", "caller_func", "call_location", "call_context")

    def contains_call(self) -> DataFrame:
        return self.unresolved_calls().join(self.files.select(F.col("path").alias("caller_file")), "caller_file", "left_semi")

    def makes_call(self) -> DataFrame:
        f = self.vertices["functions"].select(F.col("file").alias("caller_file"), F.col("name").alias("caller_func"))
        return self.unresolved_calls().where(non_empty(F.col("caller_func"))).join(f, ["caller_file", "caller_func"], "left_semi")

    def uses_type(self) -> DataFrame:
        """File -> type of that name in any file, else interfaces of that name."""
        u = self.raw["type_usages"].select("using_file", "using_entity", "usage_context", "usage_location", F.col("used_type").alias("name"), "seq")
        t = self.vertices["types"].select("name", F.col("file").alias("target_file"), F.lit("types").alias("target_kind"))
        i = self.vertices["interfaces"].select("name", F.col("file").alias("target_file"), F.lit("interfaces").alias("target_kind"))
        found = relate.fallback_join(u, t, i, "name")
        return latest(found, ["using_file", "name", "target_file", "target_kind"], ["seq"]).drop("seq")

    def extends(self) -> DataFrame:
        """Class or interface -> classes of the parent's name in any file, else interfaces of it."""
        v = self.vertices
        kinds = self._union(*[v[k].select("file", F.col("name").alias("child_name"), F.lit(k).alias("child_kind")) for k in ("classes", "interfaces")])
        children = self.raw["extends"].join(kinds, ["file", "child_name"]).select("file", "child_name", "child_kind", F.col("parent_name").alias("name"))
        target = lambda k: v[k].select("name", F.struct(F.lit(k).alias("kind"), "file").alias("target"))
        found = relate.coalesce_join(children, target("classes"), target("interfaces"), "name", "target")
        return found.select("file", "child_name", "child_kind", F.col("name").alias("parent_name"), F.col("target.kind").alias("parent_kind"), F.col("target.file").alias("parent_file")).distinct()

    def implements(self) -> DataFrame:
        c = self.vertices["classes"].select("file", F.col("name").alias("class_name"))
        i = self.vertices["interfaces"].select(F.col("name").alias("interface_name"), F.col("file").alias("interface_file"))
        return self.raw["implements"].join(c, ["file", "class_name"], "left_semi").join(i, "interface_name").select("file", "class_name", "interface_name", "interface_file").distinct()

    def create_views(self, prefix: str = "") -> None:
        """Temp views of the vertices and edges for SQL."""
        for name, df in {"files": self.files, **self.vertices}.items():
            df.createOrReplaceTempView(f"{prefix}{name}")
        for name in ("belongs_to", "defined_in", "used_in", "renders", "calls", "contains_call", "makes_call", "uses_type", "extends", "implements", "contains"):
            getattr(self, name)().createOrReplaceTempView(f"{prefix}edge_{name}")
        self.imports().createOrReplaceTempView(f"{prefix}edge_imports")

    # The published queries -----------------------------------------------------------

    def functions_of(self, path: str) -> DataFrame:
        return relate.belongs_to(self.vertices["functions"], self.files.where(F.col("path") == path), "file", "path").select("name", "signature", "start_line")

    def call_pairs(self) -> DataFrame:
        return self.calls().select(F.col("caller_func").alias("caller"), F.col("resolved_target").alias("target"), "call_location")

    def class_parents(self) -> DataFrame:
        return self.extends().where("child_kind = 'classes' and parent_kind = 'classes'").select(F.col("child_name").alias("child"), F.col("parent_name").alias("parent"))

    def interface_classes(self) -> DataFrame:
        return self.implements().select(F.col("class_name").alias("class"), F.col("interface_name").alias("interface"))

    def elements_in(self, suffix: str = ".tsx") -> DataFrame:
        return relate.belongs_to(self.vertices["jsx_elements"], self.files.where(F.col("path").endswith(suffix)), "file", "path").select("tag_name", "containing_component", F.col("file").alias("path"))

    def functions_using(self, type_name: str) -> DataFrame:
        users = self.uses_type().where((F.col("name") == type_name)).select(F.col("using_file").alias("file")).distinct()
        return self.vertices["functions"].join(users, "file").select("name", "signature", F.col("file").alias("path")).distinct()
