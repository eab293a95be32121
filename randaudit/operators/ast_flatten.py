"""Flattening of compiler ASTs, modern and legacy, to one table for each kind of record.

ASTs are rows (file_name, ast) with a variant column. Both formats give the same columns; missing keys give nulls or the
documented defaults. Of records with equal names in a contract the last stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _get(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v if isinstance(v, Column) else F.col(v), path, kind)


def _or(x: Column, default) -> Column:
    return F.coalesce(x, F.lit(default))


def ast_items(asts: DataFrame) -> DataFrame:
    """file_name, pos, legacy, kind, item: the top-level nodes; documents of neither format give none (A1)."""
    modern, old = _get("ast", "$.nodes", "array<variant>"), _get("ast", "$.children", "array<variant>")
    told = asts.withColumn("legacy", modern.isNull())
    items = told.select("file_name", "legacy", F.posexplode(F.coalesce(modern, old)).alias("pos", "item"))
    return items.withColumn("kind", F.when(F.col("legacy"), _get("item", "$.name")).otherwise(_get("item", "$.nodeType")))


def unknown_format(asts: DataFrame) -> DataFrame:
    """file_name of documents of neither format: rows of the error report (A1)."""
    return asts.where(_get("ast", "$.nodes", "array<variant>").isNull() & _get("ast", "$.children", "array<variant>").isNull()).select("file_name")


def _json(v: Column) -> Column:
    """A variant as JSON text; null for a JSON null too."""
    return F.nullif(F.to_json(v), F.lit("null"))


def directives(asts: DataFrame) -> DataFrame:
    """file_name, pos, kind, id, node (JSON text): the import and pragma records of each document (A1)."""
    found = ast_items(asts).where(F.col("kind").isin("ImportDirective", "PragmaDirective"))
    return found.select("file_name", "pos", "kind", _get("item", "$.id", "bigint").alias("id"), _json(F.col("item")).alias("node"))


def _overrides() -> Column:
    """What a function or modifier overrides, each as JSON text."""
    given = F.when(F.col("legacy"), _get("node", "$.attributes.overrides", "array<variant>")).otherwise(_get("node", "$.overrides", "array<variant>"))
    return F.transform(_or_empty(given), _json)


def _body() -> Column:
    """The body of a function or modifier as JSON text: the first Block of a legacy node."""
    blocks = F.filter(_or_empty(_get("node", "$.children", "array<variant>")), lambda c: _get(c, "$.name") == "Block")
    return F.when(F.col("legacy"), _json(F.try_element_at(blocks, F.lit(1)))).otherwise(_json(_get("node", "$.body", "variant")))


def _last(df: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "pos").alias("r")).select(*keys, "r.*")


def contract_nodes(asts: DataFrame) -> DataFrame:
    """file_name, contract, legacy, item: contract nodes with a name, the last of each name.

    A node with `attributes` is read as legacy, as compilers of that time wrote them.
    """
    nodes = ast_items(asts).where(F.col("kind") == "ContractDefinition")
    name = F.coalesce(F.when(~F.col("legacy"), _get("item", "$.name")), _get("item", "$.attributes.name"))
    named = nodes.select("file_name", name.alias("contract"), _get("item", "$.attributes", "variant").isNotNull().alias("legacy"), "item", "pos")
    return _last(named.where(F.col("contract").isNotNull()), "file_name", "contract").drop("pos")


def contracts(asts: DataFrame) -> DataFrame:
    """file_name, contract, id, type, abstract, inheritance[{name, id}] (A2, A3)."""
    c = contract_nodes(asts)
    old_bases = F.filter(
        F.transform(
            _or_empty(_get("item", "$.attributes.baseContracts", "array<variant>")),
            # Only objects count as bases there.
            lambda b: F.when(F.schema_of_variant(b).startswith("OBJECT"), F.struct(_or(_get(b, "$.name"), "Unknown").alias("name"), _or(_get(b, "$.id", "bigint"), 0).alias("id"))),
        ),
        lambda b: b.isNotNull(),
    )
    new_bases = F.transform(
        _or_empty(_get("item", "$.baseContracts", "array<variant>")),
        lambda b: F.struct(_get(b, "$.baseName.name").alias("name"), _get(b, "$.baseName.id", "bigint").alias("id")),
    )
    old = F.col("legacy")
    return c.select(
        "file_name",
        "contract",
        F.when(old, _or(_get("item", "$.id", "bigint"), 0)).otherwise(_get("item", "$.id", "bigint")).alias("id"),
        F.when(old, _or(_get("item", "$.attributes.contractKind"), "contract")).otherwise(_get("item", "$.contractKind")).alias("type"),
        F.coalesce(F.when(old, _get("item", "$.attributes.abstract", "boolean")).otherwise(_get("item", "$.abstract", "boolean")), F.lit(False)).alias("abstract"),
        F.when(old, old_bases).otherwise(new_bases).alias("inheritance"),
    )


def _or_empty(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<variant>"))


def members(asts: DataFrame) -> DataFrame:
    """file_name, contract, legacy, pos, kind, node: what stands inside the contracts."""
    inner = F.when(F.col("legacy"), _or_empty(_get("item", "$.children", "array<variant>"))).otherwise(_or_empty(_get("item", "$.nodes", "array<variant>")))
    each = contract_nodes(asts).select("file_name", "contract", "legacy", F.posexplode(inner).alias("pos", "node"))
    return each.withColumn("kind", F.when(F.col("legacy"), _get("node", "$.name")).otherwise(_get("node", "$.nodeType")))


#: The square of this is more than the levels that the JSON parser admits (1000).
TYPE_LEVELS = 32


def _plain_name(node: Column) -> Column:
    """The name of a type that holds no other."""
    kind, path = _get(node, "$.nodeType"), _get(node, "$.pathNode", "variant")
    of_path = F.startswith(F.call_function("schema_of_variant", path), F.lit("OBJECT"))
    named = F.when(kind == "ElementaryTypeName", _get(node, "$.name")).when(kind == "UserDefinedTypeName", F.when(of_path, _get(path, "$.name")).otherwise(_get(node, "$.name")))
    return F.coalesce(named.otherwise(_get(node, "$.typeString")), F.lit("unknown"))


def type_name(node: Column) -> Column:
    """The name of a type node, a VARIANT (A8); unknown where there is none.

    A list of texts and of types yet to be named is rewritten level by level until only texts are left. Types nest as deeply as the JSON parser admits; a document beyond that isn't parsed and has no types.
    """
    item = lambda text, of: F.struct(text.alias("text"), of.alias("node"))
    word = lambda text: item(text, F.lit(None).cast("variant"))
    part = lambda of, path: item(F.lit(None).cast("string"), _get(of, path, "variant"))

    def rewritten(x: Column) -> Column:
        of = x["node"]
        kind = _get(of, "$.nodeType")
        pair = F.array(word(F.lit("mapping(")), part(of, "$.keyType"), word(F.lit(" => ")), part(of, "$.valueType"), word(F.lit(")")))
        array = F.array(part(of, "$.baseType"), word(F.lit("[]")))
        return F.when(x["text"].isNotNull(), F.array(x)).when(kind == "ArrayTypeName", array).when(kind == "Mapping", pair).otherwise(F.array(word(_plain_name(of))))

    def rounds(items: Column, step: Callable[[Column], Column]) -> Column:
        """So many steps that the most deeply nested type is named, in two loops: none of an inner one is begun when nothing is left to name."""
        more = lambda x, _: F.when(F.exists(x, lambda i: i["text"].isNull()), step(x)).otherwise(x)
        return F.aggregate(F.sequence(F.lit(1), F.lit(TYPE_LEVELS)), items, more)

    named = rounds(F.array(item(F.lit(None).cast("string"), node)), lambda x: rounds(x, lambda y: F.flatten(F.transform(y, rewritten))))
    whole = lambda items: F.when(F.forall(items, lambda x: x["text"].isNotNull()), F.array_join(F.transform(items, lambda x: x["text"]), ""))
    return F.coalesce(F.get(F.transform(F.array(named), whole), 0), F.lit("unknown"))


def type_names(nodes: Column) -> Column:
    """The same for an array of type nodes."""
    return F.transform(nodes, type_name)


def parameters(df: DataFrame, node: str, path: str, out: str) -> DataFrame:
    """df with `out`: [{name, type, id, storage_location, indexed}] of a modern parameter list at a path of a node."""
    given = _or_empty(_get(node, f"{path}.parameters", "array<variant>"))
    typed = df.withColumn("_given", given).withColumn("_types", type_names(F.transform("_given", lambda p: _get(p, "$.typeName", "variant"))))
    made = F.transform(
        F.arrays_zip("_given", "_types"),
        lambda z: F.struct(
            _or(_get(z["_given"], "$.name"), "").alias("name"),
            z["_types"].alias("type"),
            _get(z["_given"], "$.id", "bigint").alias("id"),
            _or(_get(z["_given"], "$.storageLocation"), "default").alias("storage_location"),
            _or(_get(z["_given"], "$.indexed", "boolean"), False).alias("indexed"),
        ),
    )
    return typed.withColumn(out, made).drop("_given", "_types")


def _old_parameters(node: str) -> Column:
    """Parameters of the first ParameterList of a legacy function."""
    lists = F.filter(_or_empty(_get(node, "$.children", "array<variant>")), lambda c: _get(c, "$.name") == "ParameterList")
    inside = _or_empty(_get(F.try_element_at(lists, F.lit(1)), "$.children", "array<variant>"))
    return F.transform(
        F.filter(inside, lambda p: _get(p, "$.name") == "VariableDeclaration"),
        lambda p: F.struct(
            _or(_get(p, "$.attributes.name"), "").alias("name"),
            _or(_get(p, "$.attributes.type"), "unknown").alias("type"),
            _or(_get(p, "$.id", "bigint"), 0).alias("id"),
            _or(_get(p, "$.attributes.storageLocation"), "default").alias("storage_location"),
            F.lit(False).alias("indexed"),
        ),
    )


def _either(new: str, old: str, kind: str = "string", default=None, old_default=None) -> Column:
    """A field of a modern node, or the attribute of a legacy one, each with its default."""
    a, b = _get("node", f"$.{new}", kind), _get("node", f"$.{old}", kind)
    a = a if default is None else _or(a, default)
    b = b if old_default is None else _or(b, old_default)
    return F.when(F.col("legacy"), b).otherwise(a)


def functions(asts: DataFrame) -> DataFrame:
    """file_name, contract, name and the fields of each function; override and body are JSON text (A4)."""
    nodes = members(asts).where(F.col("kind") == "FunctionDefinition")
    nodes = parameters(parameters(nodes, "node", "$.parameters", "new_parameters"), "node", "$.returnParameters", "new_returns")
    unnamed = F.when(_get("node", "$.kind") == "constructor", "constructor").otherwise("fallback")
    empty = F.filter("new_returns", lambda x: F.lit(False))
    modifiers = F.transform(_or_empty(_get("node", "$.modifiers", "array<variant>")), lambda m: _get(m, "$.modifierName.name"))
    old_modifiers = F.coalesce(_get("node", "$.attributes.modifiers", "array<string>"), F.array().cast("array<string>"))
    out = nodes.select(
        "file_name",
        "contract",
        F.when(F.col("legacy"), _or(_get("node", "$.attributes.name"), "unnamed")).otherwise(F.coalesce(_get("node", "$.name"), unnamed)).alias("name"),
        _either("id", "id", "bigint", None, 0).alias("id"),
        _either("kind", "attributes.kind", "string", None, "function").alias("kind"),
        _either("visibility", "attributes.visibility", "string", None, "internal").alias("visibility"),
        _either("stateMutability", "attributes.stateMutability", "string", None, "nonpayable").alias("state_mutability"),
        _either("virtual", "attributes.virtual", "boolean", False, False).alias("virtual"),
        F.when(F.col("legacy"), _old_parameters("node")).otherwise(F.col("new_parameters")).alias("parameters"),
        F.when(F.col("legacy"), empty).otherwise(F.col("new_returns")).alias("returns"),
        F.when(F.col("legacy"), old_modifiers).otherwise(modifiers).alias("modifiers"),
        _overrides().alias("override"),
        _body().alias("body"),
        _either("implemented", "attributes.implemented", "boolean", True, True).alias("implemented"),
        "pos",
    )
    return _last(out, "file_name", "contract", "name").drop("pos")


def other_members(asts: DataFrame) -> DataFrame:
    """file_name, contract, kind, name, id, visibility, flag, override, body, members: modifiers, events, structs, enums and errors (A5).

    flag is virtual for modifiers, anonymous for events; override and body (JSON text) belong to modifiers. members are
    [{name, type, id, storage_location, indexed}]: the parameters of modifiers, events and errors, the members of structs (of these the last
    two fields are null) and the names of enums (all others null); legacy nodes have none. Errors exist in the modern format only.
    """
    kinds = ["ModifierDefinition", "EventDefinition", "StructDefinition", "EnumDefinition", "ErrorDefinition"]
    nodes = members(asts).where(F.col("kind").isin(kinds) & ~(F.col("legacy") & (F.col("kind") == "ErrorDefinition")))
    nodes = parameters(nodes, "node", "$.parameters", "params")
    inner = _or_empty(_get("node", "$.members", "array<variant>"))
    typed = nodes.withColumn("inner", inner).withColumn("types", type_names(F.transform("inner", lambda m: _get(m, "$.typeName", "variant"))))
    text, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")

    def member(m: Column, kind: Column, number: Column) -> Column:
        return F.struct(_get(m, "$.name").alias("name"), kind.alias("type"), number.alias("id"), text.alias("storage_location"), no.alias("indexed"))

    fields = F.transform(F.arrays_zip("inner", "types"), lambda z: member(z["inner"], z["types"], _get(z["inner"], "$.id", "bigint")))
    names = F.transform("inner", lambda m: member(m, text, F.lit(None).cast("bigint")))
    kind = F.col("kind")
    content = F.when(kind == "StructDefinition", fields).when(kind == "EnumDefinition", names).otherwise(F.col("params"))
    modifier = kind == "ModifierDefinition"
    out = typed.select(
        "file_name",
        "contract",
        "kind",
        _either("name", "attributes.name", "string", None, "").alias("name"),
        _either("id", "id", "bigint", None, 0).alias("id"),
        F.when(kind.isin("ModifierDefinition", "StructDefinition"), _either("visibility", "attributes.visibility", "string", "internal", "internal")).alias("visibility"),
        F.when(modifier, _either("virtual", "attributes.virtual", "boolean", False, False))
        .when(kind == "EventDefinition", _either("anonymous", "attributes.anonymous", "boolean", False, False))
        .alias("flag"),
        # A legacy modifier has none, whatever its attributes say.
        F.when(modifier, F.when(F.col("legacy"), F.array().cast("array<string>")).otherwise(_overrides())).alias("override"),
        F.when(modifier, _body()).alias("body"),
        F.when(F.col("legacy"), F.filter("params", lambda x: F.lit(False))).otherwise(content).alias("members"),
        "pos",
    )
    return _last(out, "file_name", "contract", "kind", "name").drop("pos")


def state_variables(asts: DataFrame) -> DataFrame:
    """file_name, contract, name, id, type, visibility, constant, immutable, initial_value (JSON text) of state variables."""
    nodes = members(asts).where(F.col("kind") == "VariableDeclaration").where(_either("stateVariable", "attributes.stateVariable", "boolean", False, False))
    typed = nodes.withColumn("new_type", type_name(_get("node", "$.typeName", "variant")))
    out = typed.select(
        "file_name",
        "contract",
        _either("name", "attributes.name", "string", None, "").alias("name"),
        _either("id", "id", "bigint", None, 0).alias("id"),
        F.when(F.col("legacy"), _or(_get("node", "$.attributes.type"), "unknown")).otherwise(F.col("new_type")).alias("type"),
        _either("visibility", "attributes.visibility", "string", None, "internal").alias("visibility"),
        _either("constant", "attributes.constant", "boolean", False, False).alias("constant"),
        F.when(F.col("legacy"), F.lit(False)).otherwise(_or(_get("node", "$.mutability") == "immutable", False)).alias("immutable"),
        F.when(F.col("legacy"), _json(_get("node", "$.attributes.value", "variant"))).otherwise(_json(_get("node", "$.value", "variant"))).alias("initial_value"),
        "pos",
    )
    return _last(out, "file_name", "contract", "name").drop("pos")


def imports_and_pragmas(asts: DataFrame) -> DataFrame:
    """file_name, n_imports, n_pragmas of every document that has items (A1)."""
    return ast_items(asts).groupBy("file_name").agg(
        F.count_if(F.col("kind") == "ImportDirective").alias("n_imports"), F.count_if(F.col("kind") == "PragmaDirective").alias("n_pragmas")
    )
