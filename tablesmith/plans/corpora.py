"""Templates, scripts, texts and messages.

Templates and scripts are derived from table rows, one document per row, so that
the work grows with the tables and plain SQL over the tables can check it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions import columns as C
from tablesmith.operators import codescan as K
from tablesmith.operators import graph, ranking
from tablesmith.operators import rules as Q
from tablesmith.operators import templates as A
from tablesmith.operators.ranking import Entry
from tablesmith.operators.rules import Rule
from tablesmith.plans.registry import query, table
from tablesmith.session import deal, spread

# Templates, one per order

_STORAGE = "struct<osDisk:struct<managedDisk:struct<storageAccountType:string>>>"
_PROPERTIES = f"struct<allowBlobPublicAccess:boolean,enableSoftDelete:string,storageProfile:{_STORAGE}>"
_FIELDS = {
    "name": "string", "type": "string", "apiVersion": "string", "location": "string", "tags": "struct<owner:string>",
    "sku": "struct<name:string>", "dependsOn": "array<string>", "properties": _PROPERTIES,
}
_CHILD = "array<struct<" + ",".join(f"{n}:{t}" for n, t in list(_FIELDS.items())[:3]) + ">>"


def _resource(prefix: str, kind: str, **fields: Column) -> Column:
    given = {"name": F.concat(F.lit(prefix), "o_custkey"), "type": F.lit(kind), **fields}
    columns = [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in _FIELDS.items()]
    return F.struct(*columns, given.get("resources", F.lit(None)).cast(_CHILD).alias("resources"))


def _named(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.col("o_custkey"))


def _properties(**given: Column) -> Column:
    kinds = {"allowBlobPublicAccess": "boolean", "enableSoftDelete": "string", "storageProfile": _STORAGE}
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()])


def _templates(spark, sf_dir) -> DataFrame:
    key, owner = F.col("o_orderkey"), F.struct(F.col("o_custkey").cast("string").alias("owner"))
    west, nothing = F.lit("west"), F.lit(None)
    disk = F.struct(F.struct(F.struct(F.lit("Premium").alias("storageAccountType")).alias("managedDisk")).alias("osDisk"))
    resources = F.array(
        _resource(
            "st", "Microsoft.Storage/storageAccounts",
            apiVersion=F.concat((key % 40 + 1995).cast("string"), F.lit("-06-01")),
            location=F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")),
            tags=F.when(key % 2 == 0, owner), sku=F.struct(F.lit("Standard_LRS").alias("name")),
            properties=_properties(allowBlobPublicAccess=F.when(key % 3 != 2, key % 3 == 0)),
        ),
        _resource(
            "vm", "Microsoft.Compute/virtualMachines", apiVersion=F.lit("2021-07-01"), location=west,
            dependsOn=F.array(
                F.concat(F.lit("[resourceId('Microsoft.Storage/storageAccounts', '"), _named("st"), F.lit("')]")),
                F.concat(F.lit(" "), _named("nic")),
            ),
            properties=_properties(storageProfile=F.when(key % 5 != 0, disk)),
        ),
        _resource(
            "nic", "Microsoft.Network/networkInterfaces", apiVersion=F.lit("2021-02-01"), location=west, tags=owner,
            dependsOn=F.array_compact(F.array(F.when(key % 7 == 0, _named("vm")), F.when(key % 15 == 0, _named("db")))),
        ),
        _resource(
            "kv", "Microsoft.KeyVault/vaults", location=west, tags=owner,
            properties=_properties(enableSoftDelete=(F.col("o_orderstatus") == "F").cast("string")),
            resources=F.array(
                F.struct(_named("secret"), F.lit("Microsoft.KeyVault/vaults/secrets"), F.lit("2021-10-01"))
            ),
        ),
        _resource(
            "db", "Microsoft.Sql/servers/databases", apiVersion=F.lit("2021-11-01"), location=west, tags=owner,
            sku=F.when(key % 4 != 0, F.struct(F.lit("S0").alias("name"))), dependsOn=F.array(_named("vm")),
        ),
    )
    address = F.lit("https://schema.example.org/2019-04-01/deploymentTemplate.json#")
    schema = F.when(key % 51 == 0, nothing).when(key % 53 == 0, "https://schema.example.org/other.json").otherwise(address)
    customer = F.struct(
        F.lit("int").alias("type"), F.col("o_custkey").alias("defaultValue"),
        F.struct(F.lit("Who ordered").alias("description")).alias("metadata"),
    )
    total = F.struct(F.lit("string").alias("type"), F.col("o_orderstatus").alias("value"))
    document = F.struct(
        schema.alias("$schema"), F.struct(customer.alias("customer")).alias("parameters"),
        F.struct(F.col("o_orderpriority").alias("priority")).alias("variables"),
        F.struct(total.alias("status")).alias("outputs"), resources.alias("resources"),
    )
    text = F.to_json(document)
    rows = deal(table(spark, sf_dir, "orders")).select(
        "o_orderkey", F.concat(F.lit("orders/"), key, F.lit(".json")).alias("path"), text.alias("text")
    )
    cut = F.when(key % 50 == 0, F.substring("text", 1, 40)).otherwise(F.col("text"))
    return rows.select("path", cut.alias("text"))


_NAME = "'orders/' || CAST(o_orderkey AS VARCHAR) || '.json'"
_GOOD = f"(SELECT *, {_NAME} AS template, CAST(o_custkey AS VARCHAR) AS c, o_orderkey AS k FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 51 <> 0 AND o_orderkey % 53 <> 0)"


def _resource_sql(
    prefix: str, kind: str, api="NULL", location="'west'", sku="NULL", tagged="true", depends="0", keys="''", children="0",
    parent="NULL", blob="NULL", disk="NULL", soft="NULL",
) -> str:
    provider, resource_kind = kind.split("/")[0], kind.split("/")[-1]
    return f"""
    SELECT template, '{prefix}' || c AS name, '{kind}' AS type, '{provider}' AS provider, '{resource_kind}' AS resource_kind,
           {api} AS api_version, {location} AS location, {sku} AS sku_name, CASE WHEN {tagged} THEN 1 ELSE 0 END AS tag_count,
           CASE WHEN {tagged} THEN '{{"owner":"' || c || '"}}' ELSE '{{}}' END AS tags, CAST({depends} AS INTEGER) AS depends_on_count,
           {keys} AS property_keys, {children} AS child_resources, {parent} AS parent_resource, {blob} AS "allowBlobPublicAccess",
           {disk} AS "osDiskStorageType", {soft} AS "enableSoftDelete"
    FROM {_GOOD}"""


_RESOURCES = "(" + " UNION ALL ".join(
    [
        _resource_sql(
            "st", "Microsoft.Storage/storageAccounts", "CAST(k % 40 + 1995 AS VARCHAR) || '-06-01'",
            "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END", "'Standard_LRS'", "k % 2 = 0",
            keys="CASE WHEN k % 3 <> 2 THEN 'allowBlobPublicAccess' ELSE '' END",
            blob="CASE WHEN k % 3 = 0 THEN 'true' WHEN k % 3 = 1 THEN 'false' END",
        ),
        _resource_sql(
            "vm", "Microsoft.Compute/virtualMachines", "'2021-07-01'", tagged="false", depends="2",
            keys="CASE WHEN k % 5 <> 0 THEN 'storageProfile' ELSE '' END", disk="CASE WHEN k % 5 <> 0 THEN 'Premium' END",
        ),
        _resource_sql(
            "nic", "Microsoft.Network/networkInterfaces", "'2021-02-01'",
            depends="CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 15 = 0 THEN 1 ELSE 0 END",
        ),
        _resource_sql(
            "kv", "Microsoft.KeyVault/vaults", keys="'enableSoftDelete'", children="1",
            soft="CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END",
        ),
        _resource_sql(
            "secret", "Microsoft.KeyVault/vaults/secrets", "'2021-10-01'", "NULL", tagged="false", parent="'kv' || c"
        ),
        _resource_sql(
            "db", "Microsoft.Sql/servers/databases", "'2021-11-01'", sku="CASE WHEN k % 4 <> 0 THEN 'S0' END", depends="1"
        ),
    ]
) + ")"
_RESOURCE_COLUMNS = [
    "template", "name", "type", "provider", "resource_kind", "api_version", "location", "sku_name", "tag_count", "tags",
    "depends_on_count", "property_keys", "child_resources", "parent_resource", "allowBlobPublicAccess", "osDiskStorageType",
    "enableSoftDelete",
]
_EDGES = f"""(
    SELECT template, 'vm' || c AS resource, '[resourceId(''Microsoft.Storage/storageAccounts'', ''st' || c || ''')]' AS depends_on,
           'st' || c AS resolved_name FROM {_GOOD}
    UNION ALL SELECT template, 'vm' || c, ' nic' || c, 'nic' || c FROM {_GOOD}
    UNION ALL SELECT template, 'nic' || c, 'vm' || c, 'vm' || c FROM {_GOOD} WHERE k % 7 = 0
    UNION ALL SELECT template, 'nic' || c, 'db' || c, 'db' || c FROM {_GOOD} WHERE k % 15 = 0
    UNION ALL SELECT template, 'db' || c, 'vm' || c, 'vm' || c FROM {_GOOD})"""
_CIRCLES = f"""
    SELECT template, CASE WHEN k % 15 = 0 THEN 'db' || c ELSE 'nic' || c END AS resource, 'dependency' AS type,
           'Circular dependency' AS flag, 'CRITICAL' AS severity,
           CASE WHEN k % 15 = 0 THEN 'db' || c || ' → vm' || c || ' → nic' || c || ' → db' || c
                ELSE 'nic' || c || ' → vm' || c || ' → nic' || c END AS detail
    FROM {_GOOD} WHERE k % 15 = 0 OR k % 7 = 0"""
_FLAGS = f"""(
    SELECT template, name AS resource, type, 'Missing apiVersion' AS flag, 'HIGH' AS severity,
           'Resource missing explicit API version' AS detail FROM {_RESOURCES} WHERE api_version IS NULL
    UNION ALL SELECT template, name, type, 'Public blob access not restricted', 'HIGH', 'allowBlobPublicAccess is enabled or not set'
    FROM {_RESOURCES} WHERE resource_kind = 'storageAccounts' AND coalesce("allowBlobPublicAccess", 'true') = 'true'
    UNION ALL SELECT template, name, type, 'No managed disk defined', 'HIGH', 'VM lacks managed disk for OS'
    FROM {_RESOURCES} WHERE resource_kind = 'virtualMachines' AND "osDiskStorageType" IS NULL
    UNION ALL SELECT template, name, type, 'Missing location', 'MEDIUM', 'Resource has no explicit location'
    FROM {_RESOURCES} WHERE location IS NULL
    UNION ALL SELECT template, name, type, 'Outdated API version', 'MEDIUM', 'Using ' || api_version || ' (older than 2020-01-01)'
    FROM {_RESOURCES} WHERE api_version < '2020-01-01'
    UNION ALL SELECT template, name, type, 'Soft delete not enabled', 'MEDIUM', 'KeyVault should enable soft delete protection'
    FROM {_RESOURCES} WHERE type LIKE '%vaults%' AND coalesce("enableSoftDelete", 'false') <> 'true'
    UNION ALL SELECT template, name, type, 'No tags defined', 'LOW', 'Resource has no tags for organization/billing'
    FROM {_RESOURCES} WHERE tag_count = 0
    UNION ALL SELECT template, name, type, 'SKU not defined', 'LOW', 'Resource typically requires explicit SKU'
    FROM {_RESOURCES} WHERE resource_kind = 'databases' AND sku_name IS NULL
    UNION ALL {_CIRCLES})"""


@query(
    f"""
    SELECT {_NAME} AS template, CASE WHEN o_orderkey % 50 = 0 THEN 'Invalid JSON' WHEN o_orderkey % 51 = 0 THEN 'Missing $schema'
           ELSE 'Unknown schema: https://schema.example.org/other.json' END AS error
    FROM orders WHERE o_orderkey % 50 = 0 OR o_orderkey % 51 = 0 OR o_orderkey % 53 = 0
    """
)
def template_errors(spark, sf_dir):
    return A.template_errors(A.parse_templates(_templates(spark, sf_dir)))


def _resources(spark, sf_dir, *columns: str) -> DataFrame:
    return A.extract_resources(A.parse_templates(_templates(spark, sf_dir)), columns=columns)


@query(f"SELECT * FROM {_RESOURCES}")
def template_resources(spark, sf_dir):
    return _resources(spark, sf_dir, *_RESOURCE_COLUMNS[1:]).select(*_RESOURCE_COLUMNS)


@query(
    f"""
    SELECT 'deep/' || CAST(o_orderkey AS VARCHAR) AS template, 'r' || CAST(i AS VARCHAR) AS name, CASE WHEN i > 1 THEN 'r' || CAST(i - 1 AS VARCHAR) END AS parent_resource,
        CASE WHEN i < o_orderkey % 21 THEN 1 ELSE 0 END AS child_resources
    FROM (SELECT o_orderkey, unnest(range(1, o_orderkey % 21 + 1)) AS i FROM orders)
    """
)
def template_nesting(spark, sf_dir):
    """Templates of up to twenty levels of resources in resources, one per order."""
    depth = (F.col("o_orderkey") % 21).cast("int")
    opened = F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.lit('{"name":"r'), i.cast("string"), F.lit('","type":"T","resources":[')))
    begin = F.lit('{"$schema":"https://schema.example.org/deploymentTemplate.json#","resources":[')
    text = F.concat(begin, F.when(depth > 0, F.array_join(opened, "")).otherwise(""), F.repeat(F.lit("]}"), depth), F.lit("]}"))
    texts = deal(table(spark, sf_dir, "orders")).select(F.concat(F.lit("deep/"), "o_orderkey").alias("path"), text.alias("text"))
    return A.extract_resources(A.parse_templates(texts), columns=["name", "parent_resource", "child_resources"])


_NETWORK_SQL = """
    SELECT 'net/' || CAST(s_suppkey AS VARCHAR) AS template, 'vnet' AS name, '10.' || CAST(s_suppkey % 200 AS VARCHAR) || '.0.0/16,10.250.0.0/24' AS "addressPrefixes",
        s_suppkey % 4 AS "subnetCount", CASE WHEN s_suppkey % 3 = 0 THEN '10.0.0.4' ELSE '' END AS "dnsServers",
        NULL AS "ruleCount", NULL AS "inboundRules", NULL AS "outboundRules", NULL AS "accessPolicieCount", NULL AS "vmSize", NULL AS "accessTier", NULL AS "minimumTlsVersion"
    FROM supplier
    UNION ALL SELECT 'net/' || CAST(s_suppkey AS VARCHAR), 'nsg', NULL, NULL, NULL, s_suppkey % 5 + s_suppkey % 2, s_suppkey % 5, s_suppkey % 2, NULL, NULL, NULL, NULL FROM supplier
    UNION ALL SELECT 'net/' || CAST(s_suppkey AS VARCHAR), 'kv', NULL, NULL, NULL, NULL, NULL, NULL, 2, NULL, NULL, NULL FROM supplier
    UNION ALL SELECT 'net/' || CAST(s_suppkey AS VARCHAR), 'vm', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'B' || CAST(s_suppkey % 8 AS VARCHAR), NULL, NULL FROM supplier
    UNION ALL SELECT 'net/' || CAST(s_suppkey AS VARCHAR), 'st', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Hot', 'TLS1_2' FROM supplier
"""


@query(_NETWORK_SQL)
def template_families(spark, sf_dir):
    """The special attributes of all five families of resources, a template per supplier."""
    key = F.col("s_suppkey")

    def times(text: str, count: Column) -> Column:
        return F.array_join(F.array_repeat(F.lit(text), count.cast("int")), ",")

    def resource(name: str, kind: str, *properties: Column | str) -> Column:
        parts = [F.lit(p) if isinstance(p, str) else p for p in properties]
        return F.concat(F.lit('{"name":"' + name + '","type":"' + kind + '","properties":{'), *parts, F.lit("}}"))

    rules = [times('{"direction":"Inbound"}', key % 5), times('{"direction":"Outbound"}', key % 2)]
    listed = [
        resource(
            "vnet", "Microsoft.Network/virtualNetworks", '"addressSpace":{"addressPrefixes":["10.', (key % 200).cast("string"), '.0.0/16","10.250.0.0/24"]},"subnets":[',
            times("{}", key % 4), "]", F.when(key % 3 == 0, ',"dhcpOptions":{"dnsServers":["10.0.0.4"]}').otherwise(""),
        ),
        resource("nsg", "Microsoft.Network/networkSecurityGroups", '"securityRules":[', F.array_join(F.filter(F.array(*rules), lambda r: r != ""), ","), "]"),
        resource("kv", "Microsoft.KeyVault/vaults", '"accessPolicies":[{},{}]'),
        resource("vm", "Microsoft.Compute/virtualMachines", '"hardwareProfile":{"vmSize":"B', (key % 8).cast("string"), '"}'),
        resource("st", "Microsoft.Storage/storageAccounts", '"accessTier":"Hot","minimumTlsVersion":"TLS1_2"'),
    ]
    text = F.concat(F.lit('{"$schema":"https://schema.example.org/deploymentTemplate.json#","resources":['), F.concat_ws(",", *listed), F.lit("]}"))
    texts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("net/"), key.cast("string")).alias("path"), text.alias("text"))
    found = A.extract_resources(A.parse_templates(texts))
    names = ["addressPrefixes", "subnetCount", "dnsServers", "ruleCount", "inboundRules", "outboundRules", "accessPolicieCount", "vmSize", "accessTier", "minimumTlsVersion"]
    return found.select("template", "name", *names)


@query(f"SELECT name, type FROM {_RESOURCES} WHERE parent_resource IS NULL")
def template_top_level(spark, sf_dir):
    parsed = A.parse_templates(_templates(spark, sf_dir))
    return A.extract_resources(parsed, include_children=False, columns=["name", "type"]).select("name", "type")


@query(f"SELECT * FROM {_EDGES}")
def template_dependencies(spark, sf_dir):
    return A.dependencies(_resources(spark, sf_dir, "name", "depends_on"))


@query(f"SELECT * FROM {_FLAGS}")
def template_flags(spark, sf_dir):
    resources = _resources(spark, sf_dir, *A.RISK_COLUMNS)
    return A.risk_flags(resources, A.dependencies(resources))


@query(f"SELECT type, count(*) AS resources FROM {_RESOURCES} GROUP BY type")
def template_types(spark, sf_dir):
    return A.type_counts(_resources(spark, sf_dir, "type"))


@query(
    f"""
    SELECT template, 'customer' AS name, 'int' AS type, c AS "default", 'Who ordered' AS description FROM {_GOOD}
    """
)
def template_parameters(spark, sf_dir):
    return A.parameters(A.parse_templates(_templates(spark, sf_dir)))


@query(
    f"""
    SELECT template, 'priority' AS name, NULL AS type, '"' || o_orderpriority || '"' AS value, 'variable' AS part FROM {_GOOD}
    UNION ALL SELECT template, 'status', 'string', '"' || o_orderstatus || '"', 'output' FROM {_GOOD}
    """
)
def template_values(spark, sf_dir):
    parsed = A.parse_templates(_templates(spark, sf_dir))
    named = A.variables(parsed).withColumn("part", F.lit("variable"))
    return named.unionByName(A.outputs(parsed).withColumn("part", F.lit("output")), allowMissingColumns=True)


@query(
    f"""
    SELECT template, CAST(1 AS BIGINT) AS parameters, CAST(1 AS BIGINT) AS variables, CAST(1 AS BIGINT) AS outputs, resources,
           types, dependencies, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
           coalesce(low, 0) AS low
    FROM (SELECT template, count(*) AS resources, count(DISTINCT type) AS types, CAST(sum(depends_on_count) AS BIGINT) AS dependencies
          FROM {_RESOURCES} GROUP BY template)
    LEFT JOIN (SELECT template, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
               count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low
               FROM {_FLAGS} GROUP BY template) USING (template)
    """
)
def template_summary(spark, sf_dir):
    parsed = A.parse_templates(_templates(spark, sf_dir))
    resources = _resources(spark, sf_dir, *A.RISK_COLUMNS)
    edges = A.dependencies(resources)
    return A.template_summary(parsed, resources, edges, A.risk_flags(resources, edges))


@query(
    """
    WITH RECURSIVE edges AS (
        SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS s, l_partkey % 7 + 1 AS t FROM lineitem),
    reach AS (
        SELECT l_orderkey, s, t FROM edges
        UNION SELECT r.l_orderkey, r.s, e.t FROM reach r JOIN edges e ON r.l_orderkey = e.l_orderkey AND r.t = e.s)
    SELECT l_orderkey, s AS node FROM reach WHERE s = t
    """
)
def cycle_detection(spark, sf_dir):
    """Line numbers of an order that lead back to themselves, where parts point to lines."""
    edges = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"), (F.col("l_partkey") % 7 + 1).alias("next")
    )
    return graph.cyclic_nodes(edges, ["l_orderkey"], "line", "next")


@query(
    """
    SELECT o.o_orderkey AS node, p.o_orderkey - 7 AS root
    FROM orders o JOIN orders p ON p.o_orderkey % 50 = 0 AND p.o_orderkey > 0 AND o.o_orderkey BETWEEN p.o_orderkey - 7 AND p.o_orderkey
    """
)
def cycle_components(spark, sf_dir):
    """Orders that lead back to themselves in one graph of all orders: a path through all, with a way back of seven steps at every fiftieth."""
    key = F.col("o_orderkey")
    steps = F.when((key % 50 == 0) & (key > 0), F.array(key + 1, key - 7)).otherwise(F.array(key + 1))
    edges = table(spark, sf_dir, "orders").select(key.alias("s"), F.explode(steps).alias("t"))
    return graph.cyclic_edges(edges, [], "s", "t").select(F.col("s").alias("node"), "root").distinct()


# Scripts, one per part


def _scripts(spark, sf_dir) -> DataFrame:
    size = F.col("p_size")
    text = F.concat_ws(
        "\n",
        F.lit("import pandas as pd"),
        F.lit("%run ./setup"),
        F.format_string("base = '/mnt/%s'", "p_type"),
        F.format_string("df = pd.read_csv(base + '/%d.csv')", "p_partkey"),
        F.format_string("other = pd.read_parquet(f'{base}/%d.parquet')", "p_size"),
        F.when(size % 2 == 0, F.format_string("df.to_json('out/%d.json', orient='records')", "p_partkey")).otherwise("df.to_csv(target)"),
        F.lit("m = df['t'].dt.to_period('M')"),
        F.when(size % 9 == 0, "sc = SparkContext(); sc.textFile('x'); sc.stop(); sc.stop(); sc.stop()").when(size % 3 == 0, "sc = SparkContext(); sc.textFile('x')"),
        F.when(size % 4 == 0, "r = df.rdd"),
        F.when(size % 5 == 0, "c = SQLContext(s)"),
        F.when(size % 10 == 0, "def broken(:"),
    )
    return deal(table(spark, sf_dir, "part")).select(F.format_string("jobs/%d.py", "p_partkey").alias("path"), text.alias("text"))


_SCRIPT = "'jobs/' || CAST(p_partkey AS VARCHAR) || '.py'"
_PARSED = f"(SELECT *, {_SCRIPT} AS f, CAST(p_partkey AS VARCHAR) AS k, CAST(p_size AS VARCHAR) AS z FROM part WHERE p_size % 10 <> 0)"


@query(
    f"""
    SELECT f AS file_path, 4 AS line_number, 'pandas_read_csv' AS operation_type, 'pd.read_csv(base + ''/' || k || '.csv'')' AS code_content,
           '/mnt/' || p_type || '/' || k || '.csv' AS path_used, 'expression' AS variable_name, true AS is_mount_point FROM {_PARSED}
    UNION ALL SELECT f, 5, 'pandas_read_parquet', 'pd.read_parquet(f''{{base}}/' || z || '.parquet'')',
           '/mnt/' || p_type || '/' || z || '.parquet', 'expression', true FROM {_PARSED}
    UNION ALL SELECT f, 6, 'pandas_to_json', 'df.to_json(''out/' || k || '.json'', orient=''records'')', 'out/' || k || '.json', NULL, false
    FROM {_PARSED} WHERE p_size % 2 = 0
    UNION ALL SELECT f, 6, 'pandas_to_csv', 'df.to_csv(target)', NULL, 'target', false FROM {_PARSED} WHERE p_size % 2 <> 0
    """
)
def code_access(spark, sf_dir):
    return K.access_findings(K.script_facts(_scripts(spark, sf_dir)))


_K = "CAST(p_partkey AS VARCHAR)"


@query(
    f"""
    SELECT {_SCRIPT} AS file_path, 3 AS line_number, '/mnt/in/' || {_K} AS path_used FROM part
    UNION ALL SELECT {_SCRIPT}, 5, '/mnt/out/' || {_K} FROM part
    UNION ALL SELECT {_SCRIPT}, 8, CASE WHEN p_size % 2 = 0 THEN '/mnt/out/' || {_K} END FROM part
    UNION ALL SELECT {_SCRIPT}, 10, NULL FROM part
    UNION ALL SELECT {_SCRIPT}, 12, 'root/x.csv' FROM part
    UNION ALL SELECT {_SCRIPT}, 14, '/mnt/out/' || {_K} || '.bak' FROM part WHERE p_size % 2 = 0
    UNION ALL SELECT {_SCRIPT}, 14, NULL FROM part WHERE p_size % 2 <> 0
    """
)
def code_rebound_paths(spark, sf_dir):
    """Paths held by names that are bound again, in branches, loops and functions: what a name holds where it is used."""
    key = F.col("p_partkey").cast("string")
    other = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("    p = '/mnt/out/"), key, F.lit("'"))).otherwise("    p = '/mnt/else'")
    text = F.concat_ws(
        "\n",
        F.lit("root = 'root'"), F.concat(F.lit("p = '/mnt/in/"), key, F.lit("'")), F.lit("a = pd.read_csv(p)"), F.concat(F.lit("p = '/mnt/out/"), key, F.lit("'")),
        F.lit("a.to_csv(p)"), F.lit("if late:"), other, F.lit("b = pd.read_json(p)"), F.lit("for q in names():"), F.lit("    c = pd.read_csv(q)"),
        F.lit("def f(p):"), F.lit("    return pd.read_csv(root + '/x.csv')"), F.lit("p += '.bak'"), F.lit("pd.read_csv(p)"),
    )
    scripts = deal(table(spark, sf_dir, "part")).select(F.format_string("jobs/%d.py", "p_partkey").alias("path"), text.alias("text"))
    return K.access_findings(K.script_facts(scripts, code=False)).select("file_path", "line_number", "path_used")


@query(
    f"""
    SELECT f AS file_path, 3 AS line_number, 'mount_point_reference' AS operation_type, '/mnt/' || p_type AS path_used FROM {_PARSED}
    """
)
def code_mounts(spark, sf_dir):
    return K.mount_references(K.script_facts(_scripts(spark, sf_dir), code=False))


@query(
    f"""
    SELECT {_SCRIPT} AS file_path, p_size % 10 <> 0 AS parsed, CAST(CASE WHEN p_size % 10 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS reads,
           CAST(CASE WHEN p_size % 10 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS writes,
           CAST(CASE WHEN p_size % 10 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS mount_points
    FROM part
    """
)
def code_counts(spark, sf_dir):
    return K.access_counts(K.script_facts(_scripts(spark, sf_dir), code=False))


@query(
    f"""
    SELECT {_SCRIPT} AS path, 'sc.' AS flag, 'HIGH' AS severity, 'Use SparkSession instead of SparkContext' AS detail FROM part WHERE p_size % 3 = 0
    UNION ALL SELECT {_SCRIPT}, 'RDD usage', 'MEDIUM', 'Use DataFrames API for better performance' FROM part WHERE p_size % 4 = 0
    """
)
def migration_flags(spark, sf_dir):
    return K.migration_flags(_scripts(spark, sf_dir))


@query(
    f"""
    SELECT {_SCRIPT} AS path, CAST(CASE WHEN p_size % 9 = 0 THEN 4 WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS high,
           CASE WHEN p_size % 9 = 0 THEN 'CRITICAL' WHEN p_size % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level
    FROM part
    """
)
def migration_risk(spark, sf_dir):
    return K.migration_risk(_scripts(spark, sf_dir))


@query(f"SELECT {_SCRIPT} AS path, 'SQLContext' AS old, 'Use SparkSession' AS new FROM part WHERE p_size % 5 = 0")
def old_interfaces(spark, sf_dir):
    return K.old_interfaces(_scripts(spark, sf_dir))


@query(
    """
    SELECT p_partkey, p_size % 6 = 0 AS is_safe,
           CASE p_size % 6 WHEN 0 THEN 'Safe' WHEN 1 THEN 'Dangerous function ''open'' detected' WHEN 2 THEN 'Module ''os'' not allowed'
                WHEN 3 THEN 'Operation ''to_csv'' not allowed (only read operations)' WHEN 4 THEN 'Invalid Python syntax'
                ELSE 'Code must be a single function call' END AS reason
    FROM part
    """
)
def snippet_safety(spark, sf_dir):
    forms = ["pd.read_csv('%d.csv')", "pd.read_csv(open('%d'))", "os.system('%d')", "pd.to_csv('%d')", "x = %d", "%d + 1"]
    text = F.element_at(F.array(*[F.format_string(f, "p_partkey") for f in forms]), F.col("p_size") % 6 + 1)
    snippets = deal(table(spark, sf_dir, "part")).select("p_partkey", text.alias("text"))
    return K.snippet_safety(snippets).drop("text")


# Texts


@query(
    """
    SELECT doc_id, 'mail' AS flag, 'HIGH' AS severity, 'mentions an address' AS detail FROM documents WHERE contains(text, '@')
    UNION ALL SELECT doc_id, 'link', 'MEDIUM', lang FROM documents WHERE contains(lower(text), 'http')
    UNION ALL SELECT doc_id, 'licence', 'LOW', source FROM documents WHERE contains(lower(text), 'license')
    """
)
def text_rule_scan(spark, sf_dir):
    lower = F.lower("text")
    rules = [
        Rule("mail", "HIGH", F.col("text").contains("@"), "mentions an address"),
        Rule("link", "MEDIUM", lower.contains("http"), F.col("lang")),
        Rule("licence", "LOW", lower.contains("license"), F.col("source")),
    ]
    return Q.flag_rows(table(spark, sf_dir, "documents"), rules, ["doc_id"])


_WORDS = {"the": "THE", "de": "DE", "und": "UND"}
_SUBSTITUTED = "text"
for _old, _new in _WORDS.items():
    _SUBSTITUTED = f"regexp_replace({_SUBSTITUTED}, '\\b{_old}\\b', '{_new}', 'g')"


@query(f"SELECT doc_id, {_SUBSTITUTED} AS text FROM documents")
def text_substitute(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.replace_words("text", _WORDS).alias("text"))


_TRIMMED = r"regexp_replace({}, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g')"
_LINES = f"""
    SELECT doc_id, unnest(string_split(text, chr(10))) AS a, unnest(string_split({_SUBSTITUTED}, chr(10))) AS b,
           unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number FROM documents"""
_CHANGED = f"""(
    SELECT doc_id, CAST(line_number AS INTEGER) AS line_number, {_TRIMMED.format("a")} AS original, {_TRIMMED.format("b")} AS converted
    FROM ({_LINES}) WHERE a <> b AND {_TRIMMED.format("a")} <> '' AND {_TRIMMED.format("b")} <> '')"""


@query(f"SELECT * FROM {_CHANGED}")
def line_diff(spark, sf_dir):
    changes = K.line_changes(F.col("text"), C.replace_words("text", _WORDS))
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", F.explode(changes).alias("_c"))
    return rows.select("doc_id", "_c.line_number", "_c.original", "_c.converted")


@query(
    f"""
    SELECT doc_id, coalesce(changes, 0) AS changes,
           greatest(least(1.0::DOUBLE - coalesce(changes, 0) * 0.05::DOUBLE, 1.0::DOUBLE), 0.6::DOUBLE) AS confidence
    FROM documents LEFT JOIN (SELECT doc_id, CAST(count(*) AS INTEGER) AS changes FROM {_CHANGED} GROUP BY doc_id) USING (doc_id)
    """
)
def line_diff_confidence(spark, sf_dir):
    changes = F.size(K.line_changes(F.col("text"), C.replace_words("text", _WORDS)))
    counted = spread(table(spark, sf_dir, "documents")).select("doc_id", changes.alias("changes"))
    return counted.withColumn("confidence", K.confidence(F.col("changes")))


# Messages

CATALOG = [
    Entry("articles", ("the", "der", "la", "les"), "the der die das le la les of and"),
    Entry("questions", ("que", "qui", "what is"), "que qui what when where"),
    Entry("joining words", ("und", "and", "et", "in the"), "und and et mit with avec"),
    Entry("endings", ("tion", "heit", "keit"), "nothing shared here"),
    Entry("places", ("in", "dans", "auf", "on the"), "in on at dans sur auf"),
    Entry("negation", ("nicht", "pas", "not"), "nicht not ne pas"),
]


def _scores_sql() -> str:
    rows = []
    for position, entry in enumerate(CATALOG):
        keywords = ", ".join(f"'{k}'" for k in entry.keywords)
        words = ", ".join(f"'{w}'" for w in dict.fromkeys(entry.when_to_use.split()))
        rows.append(f"({position}, '{entry.name}', [{keywords}], [{words}])")
    return f"""(
    SELECT conv_id, turn, position, entry,
           CAST(list_sum(list_transform(keywords, lambda k: CASE WHEN list_contains(words, k) THEN 3 WHEN contains(low, k) THEN 1 ELSE 0 END)) AS DOUBLE)
           + 0.5::DOUBLE * len(list_intersect(words, uses)) AS score
    FROM (SELECT conv_id, turn, lower(text) AS low, list_distinct(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+')) AS words
          FROM conversations WHERE role = 'user'),
         (VALUES {", ".join(rows)}) AS catalog(position, entry, keywords, uses))"""


def _messages(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "conversations").where("role = 'user'"))


@query(f"SELECT conv_id, turn, entry, score FROM {_scores_sql()}")
def keyword_scores(spark, sf_dir):
    return ranking.keyword_scores(_messages(spark, sf_dir), "text", CATALOG, ["conv_id", "turn"])


@query(
    f"""
    SELECT conv_id, turn, CAST(place AS INTEGER) AS place, entry, score FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, position) AS place
        FROM {_scores_sql()} WHERE score >= 1)
    WHERE place <= 3
    """
)
def keyword_topk(spark, sf_dir):
    return ranking.keyword_topk(_messages(spark, sf_dir), "text", CATALOG, ["conv_id", "turn"])


# A catalog made from the data: every word of the benchmark, by its first two letters, is a keyword of an entry, and the last words of items tell when to use it
_WORDS_SQL = "list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
_CATALOG_SQL = f"""
    b AS (SELECT {_WORDS_SQL} AS words FROM benchmark),
    c AS (SELECT DISTINCT left(w, 2) AS entry, w AS keyword, false AS shared FROM (SELECT unnest(words) AS w FROM b)
          UNION SELECT DISTINCT left(words[1], 2), words[-1], true FROM b WHERE len(words) > 0),
    d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, list_distinct({_WORDS_SQL}) AS words FROM documents),
    t AS (SELECT doc_id, unnest(words) AS keyword FROM d),
    h AS (SELECT d.doc_id, k.keyword, t.keyword IS NOT NULL AS whole
          FROM d JOIN (SELECT DISTINCT keyword FROM c) k ON contains(d.low, k.keyword) LEFT JOIN t ON t.doc_id = d.doc_id AND t.keyword = k.keyword),
    s AS (SELECT doc_id, entry, sum(CASE WHEN shared THEN CASE WHEN whole THEN 0.5::DOUBLE ELSE 0 END WHEN whole THEN 3::DOUBLE ELSE 1::DOUBLE END) AS score
          FROM h JOIN c USING (keyword) GROUP BY doc_id, entry)
"""


def _catalog(spark, sf_dir) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), r"[ \t\n\r\f]+"), lambda w: w != "")
    items = table(spark, sf_dir, "benchmark").select(words.alias("words")).where(F.size("words") > 0)
    every = items.select(F.explode("words").alias("keyword")).select(F.left("keyword", F.lit(2)).alias("entry"), "keyword", F.lit(False).alias("shared"))
    use = items.select(F.left(F.get("words", F.lit(0)), F.lit(2)).alias("entry"), F.element_at("words", -1).alias("keyword"), F.lit(True).alias("shared"))
    return every.unionByName(use).distinct()


@query(f"WITH {_CATALOG_SQL} SELECT doc_id, entry, score FROM s WHERE score > 0")
def catalog_scores(spark, sf_dir):
    """Points of all documents for a catalog of thousands of keywords, kept as a table."""
    return ranking.catalog_scores(table(spark, sf_dir, "documents"), "text", _catalog(spark, sf_dir), ["doc_id"])


@query(
    f"""
    WITH {_CATALOG_SQL}
    SELECT doc_id, CAST(place AS INTEGER) AS place, entry, score
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, entry) AS place FROM s WHERE score >= 1) WHERE place <= 3
    """
)
def catalog_topk(spark, sf_dir):
    return ranking.catalog_topk(table(spark, sf_dir, "documents"), "text", _catalog(spark, sf_dir), ["doc_id"])


@query(
    f"""
    WITH d AS (SELECT DISTINCT p_type AS old, 'lake/' || p_type AS "new" FROM part)
    SELECT {_SCRIPT} AS path, d.old, d."new", CAST((length(p_type) - length(replace(p_type, d.old, ''))) // length(d.old) AS BIGINT) AS times
    FROM part JOIN d ON contains(p_type, d.old)
    """
)
def dictionary_findings(spark, sf_dir):
    """Names of a dictionary, which is a table, in all scripts."""
    kinds = table(spark, sf_dir, "part").select(F.col("p_type").alias("old"), F.concat(F.lit("lake/"), "p_type").alias("new")).distinct()
    return K.dictionary_findings(_scripts(spark, sf_dir), kinds)
