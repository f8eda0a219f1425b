import json

import pytest

from tablesmith.operators import templates as A
from tablesmith.sources.folders import read_texts

ST, VM, NIC = "Microsoft.Storage/storageAccounts", "Microsoft.Compute/virtualMachines", "Microsoft.Network/networkInterfaces"
KV, DB = "Microsoft.KeyVault/vaults", "Microsoft.Sql/servers/databases"
SCHEMA = "https://schema.example.org/2019-04-01/deploymentTemplate.json#"
TAG = {"owner": "me"}
T1 = {
    "$schema": SCHEMA,
    "parameters": {"env": {"type": "string", "defaultValue": "dev", "metadata": {"description": "stage"}}},
    "variables": {"n": 3},
    "outputs": {"id": {"type": "string", "value": "x"}},
    "resources": [
        {"name": "st1", "type": ST, "apiVersion": "2019-06-01", "location": "westeurope", "tags": TAG,
         "sku": {"name": "Standard_LRS"}, "properties": {"supportsHttpsTrafficOnly": True}},
        {"name": "vm1", "type": VM, "apiVersion": "2021-07-01", "location": "westeurope",
         "dependsOn": ["nic1", f"[resourceId('{ST}', 'st1')]"], "properties": {"hardwareProfile": {"vmSize": "B1"}}},
        {"name": "nic1", "type": NIC, "apiVersion": "2021-02-01", "tags": TAG, "dependsOn": ["vm1"]},
        {"name": "kv1", "type": KV, "location": "westeurope", "tags": TAG, "properties": {"enableSoftDelete": False},
         "resources": [{"name": "secret1", "type": KV + "/secrets", "apiVersion": "2021-10-01"}]},
        {"name": "db1", "type": DB, "apiVersion": "2021-11-01", "location": "westeurope", "tags": TAG},
    ],
}


def graph_template(*edges):
    names = dict.fromkeys(n for e in edges for n in e)
    return {
        "$schema": SCHEMA,
        "resources": [{"name": n, "type": "T/x", "dependsOn": [t for s, t in edges if s == n]} for n in names],
    }


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("templates")
    (folder / "t1.json").write_text(json.dumps(T1))
    (folder / "bad.json").write_text("{ broken")
    (folder / "other.json").write_text('{"resources": []}')
    (folder / "chain.json").write_text(json.dumps(graph_template(("p", "x"), ("x", "y"), ("y", "z"), ("z", "x"))))
    return read_texts(spark, str(folder), "*.json")


@pytest.fixture(scope="module")
def t1(texts):
    return A.parse_templates(texts.where("path = 't1.json'"))


def test_errors_lose_nothing_else(texts):
    found = {r["template"]: r["error"] for r in A.template_errors(A.parse_templates(texts)).collect()}
    assert found == {"bad.json": "Invalid JSON", "other.json": "Missing $schema"}


def test_resources(t1):
    rows = {r["name"]: r for r in A.extract_resources(t1).collect()}
    assert set(rows) == {"st1", "vm1", "nic1", "kv1", "secret1", "db1"}
    assert rows["secret1"]["parent_resource"] == "kv1" and rows["kv1"]["child_resources"] == 1
    assert rows["st1"]["supportsHttpsTrafficOnly"] == "true" and rows["st1"]["allowBlobPublicAccess"] is None
    assert rows["vm1"]["vmSize"] == "B1" and rows["vm1"]["provider"] == "Microsoft.Compute"
    assert rows["st1"]["tags"] == '{"owner":"me"}' and rows["vm1"]["tags"] == "{}"
    assert A.extract_resources(t1, include_children=False).count() == 5
    assert A.type_counts(A.extract_resources(t1)).count() == 6


def test_special_attributes(spark):
    doc = {
        "$schema": SCHEMA,
        "resources": [
            {"name": "net", "type": "Microsoft.Network/virtualNetworks", "properties": {
                "addressSpace": {"addressPrefixes": ["10.0.0.0/16", "10.1.0.0/16"]}, "subnets": [{}, {}],
                "dhcpOptions": {"dnsServers": ["8.8.8.8"]}}},
            {"name": "nsg", "type": "Microsoft.Network/networkSecurityGroups", "properties": {
                "securityRules": [{"direction": "Inbound"}, {"direction": "Inbound"}, {"direction": "Outbound"}]}},
        ],
    }
    parsed = A.parse_templates(spark.createDataFrame([("d", json.dumps(doc))], "path string, text string"))
    rows = {r["name"]: r for r in A.extract_resources(parsed).collect()}
    assert rows["net"]["addressPrefixes"] == "10.0.0.0/16,10.1.0.0/16" and rows["net"]["subnetCount"] == 2
    assert (rows["nsg"]["ruleCount"], rows["nsg"]["inboundRules"], rows["nsg"]["outboundRules"]) == (3, 2, 1)
    assert rows["nsg"]["dnsServers"] is None


def test_deep_nesting_loses_nothing(spark):
    nested = {"name": "r0", "type": "T"}
    for level in range(1, 21):
        nested = {"name": f"r{level}", "type": "T", "resources": [nested]}
    doc = {"$schema": SCHEMA, "resources": [nested]}
    escaped = json.dumps(doc).replace('"resources"', '"\\u0072esources"')
    texts = spark.createDataFrame([("d", json.dumps(doc)), ("e", escaped)], "path string, text string")
    found = A.extract_resources(A.parse_templates(texts)).groupBy("template").count().collect()
    assert {r["template"]: r["count"] for r in found} == {"d": 21, "e": 21}


def test_parameters_variables_outputs(t1):
    assert tuple(A.parameters(t1).first()) == ("t1.json", "env", "string", '"dev"', "stage")
    assert tuple(A.variables(t1).first()) == ("t1.json", "n", "3")
    assert tuple(A.outputs(t1).first()) == ("t1.json", "id", "string", '"x"')


def test_dependencies_and_flags(t1):
    resources = A.extract_resources(t1)
    edges = A.dependencies(resources)
    assert {(r["resource"], r["resolved_name"]) for r in edges.collect()} == {("vm1", "nic1"), ("vm1", "st1"), ("nic1", "vm1")}
    flags = A.risk_flags(resources, edges).collect()
    found = {}
    for r in flags:
        found.setdefault(r["severity"], set()).add((r["resource"], r["flag"]))
    assert found["CRITICAL"] == {("nic1", "Circular dependency")}
    assert found["HIGH"] == {
        ("st1", "Public blob access not restricted"), ("vm1", "No managed disk defined"), ("kv1", "Missing apiVersion"),
    }
    assert found["MEDIUM"] == {
        ("st1", "Outdated API version"), ("nic1", "Missing location"), ("kv1", "Soft delete not enabled"),
        ("secret1", "Soft delete not enabled"), ("secret1", "Missing location"),
    }
    assert found["LOW"] == {("vm1", "No tags defined"), ("secret1", "No tags defined"), ("db1", "SKU not defined")}
    assert A.risk_flags(resources, edges, "HIGH").count() == 4


def test_cycle_without_its_tail(texts):
    parsed = A.parse_templates(texts.where("path = 'chain.json'"))
    flag = A.circular_flags(A.dependencies(A.extract_resources(parsed))).collect()
    assert [(r["resource"], r["detail"]) for r in flag] == [("x", "x → y → z → x")]


def test_written_inventory(spark, texts, tmp_path):
    A.write_inventory(texts, str(tmp_path))
    summary = {r["template"]: r for r in spark.read.json(f"{tmp_path}/summary").collect()}
    assert set(summary) == {"t1.json", "chain.json"}
    row = summary["t1.json"]
    assert (row["resources"], row["types"], row["dependencies"], row["parameters"]) == (6, 6, 3, 1)
    assert (row["critical"], row["high"], row["medium"], row["low"]) == (1, 3, 5, 3)
    assert spark.read.json(f"{tmp_path}/errors").count() == 2


def test_wanted_attributes_are_those_of_the_whole(t1):
    """Only what is wanted is taken out of a document, with the same values."""
    whole = A.extract_resources(t1)
    for columns in (["type"], ["name", "tag_count", "osDiskStorageType"], ["tags", "property_keys", "enableSoftDelete"], list(A.RISK_COLUMNS), ["sku_name", "depends_on", "child_resources", "parent_resource"]):
        some = A.extract_resources(t1, columns=columns)
        assert set(some.columns) == {"template", *columns}
        assert sorted(map(str, some.select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))


def test_no_document_is_parsed_to_filter_it(spark, texts):
    """A filter by the size of a list would parse documents below the exchange once more."""
    rows = A.extract_resources(A.parse_templates(texts.repartition(3)), include_children=False, columns=["name"])
    for found in (rows, A.variables(A.parse_templates(texts.repartition(3)))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1
