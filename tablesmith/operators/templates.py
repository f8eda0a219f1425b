"""Inventory, dependencies and risks of deployment templates: a folder of nested JSON documents.

Input is a table ``path, text`` with one document per row. Every result has the
column ``template``. Resources nest; a few levels of a document are unfolded inside
its row, and what lies deeper is taken from there on, so each document is parsed once and
no exchange is needed before the graph work.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.columns import SEVERITIES
from tablesmith.operators.graph import cycle_paths
from tablesmith.operators.rules import Rule, at_least, flag_rows
from tablesmith.session import stage
from tablesmith.sources.writers import write_json

#: So many levels are unfolded at once.
LEVELS = 3

# What a template schema address contains, and the API age limit.
SCHEMA_MARK = "deploymentTemplate"
OLDEST_API = "2020-01-01"
# Resource types that should name a SKU.
SKU_TYPES = ("appServicePlans", "databases", "elasticPools", "registries")


def parse_templates(texts: DataFrame) -> DataFrame:
    """Template, parsed document and, where it is no template, the reason."""
    parsed = texts.select(
        F.col("path").alias("template"), F.try_parse_json("text").alias("doc"), "text"
    )
    readable = F.get_json_object("text", "$").isNotNull()  # looked at only where there is no document
    schema = _text("doc", "$['$schema']")
    reason = (
        F.when(F.col("doc").isNull() & readable, "Repeated key")
        .when(F.col("doc").isNull(), "Invalid JSON")
        .when(schema.isNull(), "Missing $schema")
        .when(~schema.contains(SCHEMA_MARK), F.concat(F.lit("Unknown schema: "), schema))
    )
    return parsed.withColumn("error", reason).drop("text")


def template_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error IS NOT NULL").select("template", "error")


def extract_resources(parsed: DataFrame, include_children: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per resource with base and type-specific attributes, or those in ``columns``; children name their parent.

    The documents are parsed once, when this is called: resources are written to the shared folder, those at the last level unfolded
    with what they hold, from which the next levels are taken until none is left. So nesting may be of any depth.
    The resources of some levels are cast to one nested type at once; what the wanted attributes don't need is not taken out.
    """
    attributes = _attributes(columns)
    names = [c for c in attributes if columns is None or c in columns]
    top = F.try_variant_get("doc", "$.resources", f"array<{_resource_type(columns, LEVELS if include_children else 1)}>")
    # A filter on the reason would parse every document again; an empty list drops it as well.
    rows = parsed.select("template", F.when(F.col("error").isNull(), _with_parent(top, F.lit(None).cast("string"))).alias("_l0"))
    if not include_children:
        one = _each(rows, F.transform("_l0", lambda r: _entry(r, columns)), "res")
        return one.select("template", *[attributes[n].alias(n) for n in names])
    found = []
    while True:
        one = _unfolded(rows, columns).select("template", *[attributes[n].alias(n) for n in names], F.col("res._below").alias("_below"))
        level = stage(one, "resources")
        found.append(level.drop("_below"))
        deeper = level.where(F.size("_below") > 0)
        if deeper.isEmpty():
            break
        kind = _resource_type(columns, LEVELS)
        typed = F.transform("_below", lambda b: F.struct(b["parent"].alias("parent"), F.try_variant_get(b["item"], "$", kind).alias("item")))
        rows = deeper.select("template", typed.alias("_l0"))
    return functools.reduce(DataFrame.unionByName, found)


def _resource_type(columns: Sequence[str] | None, levels: int) -> str:
    """What is taken out of a resource, children of some levels included; those of the last one stay as they are."""
    below = "array<variant>" if levels == 1 else f"array<{_resource_type(columns, levels - 1)}>"
    kept = [f"{n}:{kind}" for n, kind in _kinds(columns).items() if _wanted(columns, n)]
    return f"struct<{','.join(f'{n}:string' for n in _TEXTS)},{','.join([*kept, f'resources:{below}'])}>"


def _kinds(columns: Sequence[str] | None) -> dict[str, str]:
    """Types of the parts of a resource. Keys alone are read as a map to what is cheap to cast: an entry that is no boolean keeps its key."""
    return {
        "sku": "struct<name:string,tier:string,capacity:string>", "dependsOn": "array<string>",
        "tags": "variant" if columns is None or "tags" in columns else "map<string,boolean>",
        "properties": "variant" if columns is None or "property_keys" in columns else _PROPERTIES,
    }


def _wanted(columns: Sequence[str] | None, part: str) -> bool:
    beginnings = {"sku": "sku_", "tags": "tag", "dependsOn": "depends_on"}
    if columns is None:
        return True
    if part in beginnings:
        return any(c.startswith(beginnings[part]) for c in columns)
    return bool(set(columns) - _PLAIN)


def _with_parent(items: Column, parent: Column) -> Column:
    return F.transform(items, lambda item: F.struct(parent.alias("parent"), item.alias("item")))


def _entry(found: Column, columns: Sequence[str] | None, last: bool = True) -> Column:
    """A resource without its children, which are counted; those of a resource of the last level unfolded are kept below it."""
    item = found["item"]
    below = F.coalesce(_with_parent(item["resources"], item["name"]), _nothing()) if last else _nothing()
    parts = [(item[n] if _wanted(columns, n) else F.lit(None).cast(kind)).alias(n) for n, kind in _kinds(columns).items()]
    return F.struct(
        found["parent"].alias("parent"), *[item[n].alias(n) for n in _TEXTS], *parts,
        F.coalesce(F.size(item["resources"]), F.lit(0)).alias("children"), below.alias("_below"),
    )


def _unfolded(rows: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The resources of some levels from ``_l0`` on as ``res``."""
    for level in range(1, LEVELS):
        deeper = F.transform(f"_l{level - 1}", lambda r: _with_parent(r["item"]["resources"], r["item"]["name"]))
        rows = rows.withColumn(f"_l{level}", F.flatten(F.filter(deeper, lambda items: items.isNotNull())))
    entries = [F.transform(f"_l{i}", lambda r: _entry(r, columns, i == LEVELS - 1)) for i in range(LEVELS)]
    return _each(rows, F.concat(*entries), "res")


def _each(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """A row for each item, which is never null. A plain ``explode`` adds a filter by the size of the list, which
    is pushed below any exchange and parses every document once more, in the few tasks that read the table."""
    return rows.select("template", F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def _nothing() -> Column:
    return F.array().cast("array<struct<parent:string,item:variant>>")


def _text(column: str | Column, path: str) -> Column:
    return F.try_variant_get(column, path, "string")


#: Attributes that need none of the properties.
_PLAIN = {
    "template", "name", "type", "provider", "resource_kind", "api_version", "location", "kind", "sku_name", "sku_tier", "sku_capacity", "tag_count",
    "tags", "depends_on", "depends_on_count", "child_resources", "parent_resource",
}
_TEXTS = ("name", "type", "apiVersion", "location", "kind")
_PROPERTIES = (
    "struct<accessTier:string,supportsHttpsTrafficOnly:string,minimumTlsVersion:string,allowBlobPublicAccess:string,"
    "hardwareProfile:struct<vmSize:string>,osProfile:struct<computerName:string,adminUsername:string>,"
    "storageProfile:struct<osDisk:struct<managedDisk:struct<storageAccountType:string>>>,addressSpace:struct<addressPrefixes:array<string>>,"
    "subnets:array<boolean>,dhcpOptions:struct<dnsServers:array<string>>,securityRules:array<struct<direction:string>>,"
    "enableSoftDelete:string,enablePurgeProtection:string,accessPolicies:array<boolean>>"
)


def _size(items: Column) -> Column:
    """Length of an array in the resource, zero if there is none."""
    return F.coalesce(F.size(items), F.lit(0))


def _keys(entries: Column) -> Column:
    """Names in an object of the resource, sorted; empty if there is none."""
    return F.coalesce(F.array_sort(F.map_keys(entries)), F.array().cast("array<string>"))


def _joined(items: Column) -> Column:
    return F.coalesce(F.array_join(items, ","), F.lit(""))


def _attributes(columns: Sequence[str] | None) -> dict[str, Column]:
    """The attributes of ``res``, cast for ``columns``."""
    res = F.col("res")
    kind = F.coalesce(res["type"], F.lit(""))
    parts = F.split(kind, "/")
    tags, properties = res["tags"], res["properties"]
    keys = F.array().cast("array<string>")
    if columns is None or "tags" in columns:
        tags = F.try_variant_get(tags, "$", "map<string,boolean>")
    if columns is None or "property_keys" in columns:
        keys = _keys(F.try_variant_get(properties, "$", "map<string,boolean>"))
        properties = F.try_variant_get(properties, "$", _PROPERTIES)
    base = {
        "name": F.coalesce(res["name"], F.lit("")),
        "type": kind,
        "provider": F.get(parts, F.lit(0)),
        "resource_kind": F.element_at(parts, -1),
        "api_version": res["apiVersion"],
        "location": res["location"],
        "kind": res["kind"],
        "sku_name": res["sku"]["name"],
        "sku_tier": res["sku"]["tier"],
        "sku_capacity": res["sku"]["capacity"],
        "tag_count": F.coalesce(F.size(F.map_keys(tags)), F.lit(0)),
        "tags": F.coalesce(F.to_json(res["tags"]), F.lit("{}")),
        "depends_on": F.coalesce(res["dependsOn"], F.array().cast("array<string>")),
        "depends_on_count": _size(res["dependsOn"]),
        "property_keys": F.array_join(keys, ","),
        "child_resources": res["children"],
        "parent_resource": res["parent"],
    }

    def towards(direction: str) -> Column:
        return _size(F.filter(properties["securityRules"], lambda r: r["direction"] == direction))

    # The names of the attributes. The first family whose name occurs in the type supplies the special ones.
    families = {
        "storageAccounts": {n: properties[n] for n in ("accessTier", "supportsHttpsTrafficOnly", "minimumTlsVersion", "allowBlobPublicAccess")},
        "virtualMachines": {
            "vmSize": properties["hardwareProfile"]["vmSize"],
            "computerName": properties["osProfile"]["computerName"],
            "adminUsername": properties["osProfile"]["adminUsername"],
            "osDiskStorageType": properties["storageProfile"]["osDisk"]["managedDisk"]["storageAccountType"],
        },
        "virtualNetworks": {
            "addressPrefixes": _joined(properties["addressSpace"]["addressPrefixes"]),
            "subnetCount": _size(properties["subnets"]),
            "dnsServers": _joined(properties["dhcpOptions"]["dnsServers"]),
        },
        "networkSecurityGroups": {
            "ruleCount": _size(properties["securityRules"]),
            "inboundRules": towards("Inbound"),
            "outboundRules": towards("Outbound"),
        },
        "vaults": {
            "enableSoftDelete": properties["enableSoftDelete"],
            "enablePurgeProtection": properties["enablePurgeProtection"],
            "accessPolicieCount": _size(properties["accessPolicies"]),
        },
    }
    special = {}
    earlier = F.lit(False)
    for family, attributes in families.items():
        matches = kind.contains(family) & ~earlier
        special.update({name: F.when(matches, value) for name, value in attributes.items()})
        earlier = earlier | kind.contains(family)
    return {**base, **special}


def parameters(parsed: DataFrame) -> DataFrame:
    entry = _entries(parsed, "$.parameters")
    return entry.select(
        "template", "name", _text("value", "$.type").alias("type"),
        F.to_json(F.try_variant_get("value", "$.defaultValue", "variant")).alias("default"),
        _text("value", "$.metadata.description").alias("description"),
    )


def variables(parsed: DataFrame) -> DataFrame:
    return _entries(parsed, "$.variables").select("template", "name", F.to_json("value").alias("value"))


def outputs(parsed: DataFrame) -> DataFrame:
    entry = _entries(parsed, "$.outputs")
    return entry.select(
        "template", "name", _text("value", "$.type").alias("type"),
        F.to_json(F.try_variant_get("value", "$.value", "variant")).alias("value"),
    )


def _entries(parsed: DataFrame, path: str) -> DataFrame:
    entries = F.try_variant_get("doc", path, "map<string,variant>")
    return _each(parsed, F.map_entries(F.when(F.col("error").isNull(), entries)), "_e").select("template", F.col("_e.key").alias("name"), "_e.value")


#: What findings and their summaries are made of.
RISK_COLUMNS = (
    "name", "type", "api_version", "location", "sku_name", "tag_count", "depends_on", "depends_on_count", "allowBlobPublicAccess",
    "osDiskStorageType", "enableSoftDelete",
)


def dependencies(resources: DataFrame) -> DataFrame:
    """Edges from a resource to what it depends on; ``resourceId(...)`` resolves to its last quoted name."""
    edge = resources.select("template", F.col("name").alias("resource"), F.explode("depends_on").alias("depends_on"))
    quoted = F.regexp_extract_all("depends_on", F.lit("'([^']+)'"), 1)
    last = F.when(F.col("depends_on").contains("resourceId") & (F.size(quoted) > 0), F.element_at(quoted, -1))
    return edge.withColumn("resolved_name", F.coalesce(last, F.trim("depends_on")))


def circular_flags(edges: DataFrame) -> DataFrame:
    """A CRITICAL flag per group of resources that depend on each other in a circle."""
    paths = cycle_paths(edges, ["template"], "resource", "resolved_name")
    return paths.select(
        "template", F.col("root").alias("resource"), F.lit("dependency").alias("type"),
        F.lit("Circular dependency").alias("flag"), F.lit("CRITICAL").alias("severity"),
        F.array_join("path", " → ").alias("detail"),
    )


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _is_true(name: str) -> Column:
    return F.coalesce(F.col(name).isin("true", "True"), F.lit(False))


def resource_rules() -> list[Rule]:
    kind, api = F.col("type"), F.col("api_version")
    needs_sku = F.lit(False)
    for name in SKU_TYPES:
        needs_sku = needs_sku | kind.contains(name)
    # The flags, severities and details of the findings.
    return [
        Rule("Missing apiVersion", "HIGH", _empty("api_version"), "Resource missing explicit API version"),
        Rule(
            "Public blob access not restricted", "HIGH",
            kind.contains("storageAccounts") & (F.col("allowBlobPublicAccess").isNull() | _is_true("allowBlobPublicAccess")),
            "allowBlobPublicAccess is enabled or not set",
        ),
        Rule(
            "No managed disk defined", "HIGH", kind.contains("virtualMachines") & _empty("osDiskStorageType"),
            "VM lacks managed disk for OS",
        ),
        Rule("Missing location", "MEDIUM", _empty("location"), "Resource has no explicit location"),
        Rule(
            "Outdated API version", "MEDIUM", ~_empty("api_version") & (api < OLDEST_API),
            F.concat(F.lit("Using "), api, F.lit(f" (older than {OLDEST_API})")),
        ),
        Rule(
            "Soft delete not enabled", "MEDIUM", kind.contains("vaults") & ~_is_true("enableSoftDelete"),
            "KeyVault should enable soft delete protection",
        ),
        Rule("No tags defined", "LOW", F.col("tag_count") == 0, "Resource has no tags for organization/billing"),
        Rule("SKU not defined", "LOW", needs_sku & _empty("sku_name"), "Resource typically requires explicit SKU"),
    ]


def risk_flags(resources: DataFrame, edges: DataFrame | None = None, min_severity: str = "LOW") -> DataFrame:
    """All findings of a corpus: the row rules in one pass, the circles from the edges."""
    rows = resources.withColumnRenamed("name", "resource")
    flags = flag_rows(rows, resource_rules(), ["template", "resource", "type"])
    if edges is not None:
        flags = flags.unionByName(circular_flags(edges))
    return flags if min_severity == "LOW" else at_least(flags, min_severity)


def type_counts(resources: DataFrame) -> DataFrame:
    return resources.groupBy("type").agg(F.count("*").alias("resources"))


def template_summary(parsed: DataFrame, resources: DataFrame, edges: DataFrame, flags: DataFrame) -> DataFrame:
    """One row per template: how much it holds and how many findings of each severity."""
    def entries(path: str) -> Column:
        return F.coalesce(F.size(F.try_variant_get("doc", path, "map<string,boolean>")), F.lit(0)).cast("bigint")

    counts = F.struct(*[entries(f"$.{part}").alias(part) for part in ("parameters", "variables", "outputs")])
    good = F.when(F.col("error").isNull(), F.array(counts))
    base = _each(parsed, good, "_c").select("template", "_c.*")
    held = resources.groupBy("template").agg(
        F.count("*").alias("resources"), F.count_distinct("type").alias("types"), F.sum("depends_on_count").alias("dependencies")
    )
    risks = flags.groupBy("template").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    joined = base.join(held, "template", "left").join(risks, "template", "left")
    return joined.fillna(0)


def write_inventory(texts: DataFrame, folder: str, include_children: bool = True, min_severity: str = "LOW") -> None:
    """Write every table of the inventory as a JSON dataset below ``folder``."""
    parsed = parse_templates(texts)
    resources = extract_resources(parsed, include_children)
    edges = dependencies(resources)
    flags = stage(risk_flags(resources, edges, min_severity), "flags")
    tables = {
        "errors": template_errors(parsed), "resources": resources, "dependencies": edges, "risks": flags,
        "parameters": parameters(parsed), "variables": variables(parsed), "outputs": outputs(parsed),
        "types": type_counts(resources), "summary": template_summary(parsed, resources, edges, flags),
    }
    for name, rows in tables.items():
        write_json(rows, f"{folder}/{name}")
