"""Driver queries for cloud records, assets and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import cloud as C
from eventlens.operators import graph as G
from eventlens.plans.catalog import query
from eventlens.plans.tables import SEC, sec_events, table, utc

W = f"WITH {SEC} "


def vc(e):
    return f"CAST({e} AS VARCHAR(20))"


STAMP = "concat('2024-01-', CASE WHEN event_id % 28 < 9 THEN '0' ELSE '' END, " + vc("event_id % 28 + 1") + ", 'T0', " + vc("event_id % 10") + ", ':15:30Z')"
AWS_NAME = "CASE event_id % 6 WHEN 0 THEN 'CreateUser' WHEN 1 THEN 'RunInstances' WHEN 2 THEN 'PutBucketPolicy' WHEN 3 THEN 'StopInstances' WHEN 4 THEN 'AttachUserPolicy' ELSE 'GetObject' END"
AZURE_NAME = "CASE event_id % 3 WHEN 0 THEN 'Microsoft.Compute/virtualMachines/write' WHEN 1 THEN 'Microsoft.Storage/storageAccounts/delete' ELSE 'Microsoft.Network/read' END"
GCP_NAME = "CASE event_id % 4 WHEN 0 THEN 'v1.compute.instances.insert' WHEN 1 THEN 'v1.compute.instances.stop' WHEN 2 THEN 'storage.buckets.create' ELSE 'iam.list' END"

AWS_RAW = (
    "concat('{\"eventID\":\"e', " + vc("event_id") + ", '\",\"eventName\":\"', " + AWS_NAME + ", '\",\"eventTime\":\"', " + STAMP
    + ", '\",\"userIdentity\":{\"principalId\":\"u', " + vc("user_id") + ", '\",\"type\":\"IAMUser\",\"arn\":\"arn:aws:iam::1:user/u', " + vc("user_id")
    + ", '\"},\"resources\":[{\"ARN\":\"arn:', " + vc("event_id % 50") + ", '\",\"type\":\"AWS::EC2\"},{\"ARN\":\"other\"}],\"sourceIPAddress\":\"10.0.0.', " + vc("event_id % 250")
    + ", '\",\"awsRegion\":\"us-east-1\",\"recipientAccountId\":\"', " + vc("user_id % 7") + ", '\"', CASE WHEN event_type = 'error' THEN ',\"errorCode\":\"AccessDenied\",\"errorMessage\":\"no\"' ELSE '' END, '}')"
)
AZURE_RAW = (
    "concat('{\"eventDataId\":\"z', " + vc("event_id") + ", '\",\"operationName\":\"', " + AZURE_NAME + ", '\",\"eventTimestamp\":\"', " + STAMP
    + ", '\",\"caller\":\"u', " + vc("user_id") + ", '@example.com\",\"resourceId\":\"/vm/', " + vc("event_id % 40") + ", '\",\"resourceType\":\"vm\"', CASE WHEN event_id % 9 = 0 THEN '' ELSE concat(',\"status\":{\"value\":\"', CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Succeeded' END, '\"}') END, '}')"
)
GCP_RAW = (
    "concat('{\"insertId\":\"g', " + vc("event_id") + ", '\",\"timestamp\":\"', " + STAMP + ", '\",\"protoPayload\":{\"methodName\":\"', " + GCP_NAME
    + ", '\",\"authenticationInfo\":{\"principalEmail\":\"u', " + vc("user_id") + ", '@example.com\"},\"resourceName\":\"projects/', " + vc("event_id % 30") + ", '\"', CASE WHEN event_id % 9 = 0 THEN '' ELSE concat(',\"status\":{\"code\":', CASE WHEN event_type = 'error' THEN '7' ELSE '0' END, '}') END, '}}')"
)


def raw(spark, sf, expression, name="events"):
    return table(spark, sf, name).selectExpr(f"{expression} AS value")


OUT = ["id", "provider", "event_type", "event_name", "ts", "actor_id", "actor_type", "actor_name", "resource_id", "resource_type", "source_ip", "region", "account", "success", "error_code", "error_message"]
TS = f"CAST(replace(replace({STAMP}, 'T', ' '), 'Z', '') AS TIMESTAMP)"
AWS_TYPE = f"CASE event_id % 6 WHEN 0 THEN 'iam:user:create' WHEN 1 THEN 'compute:instance:create' WHEN 2 THEN 'storage:bucket:create' WHEN 3 THEN 'compute:instance:stop' WHEN 4 THEN 'iam:policy:attach' ELSE {AWS_NAME} END"
AZURE_TYPE = f"CASE event_id % 3 WHEN 0 THEN 'compute:instance:create' ELSE {AZURE_NAME} END"
GCP_TYPE = f"CASE event_id % 4 WHEN 0 THEN 'compute:instance:create' WHEN 2 THEN 'storage:bucket:create' ELSE {GCP_NAME} END"
AWS_SQL = f"""SELECT 'e' || event_id AS id, 'aws' AS provider, {AWS_TYPE} AS event_type, {AWS_NAME} AS event_name, {TS} AS ts, 'u' || user_id AS actor_id, 'IAMUser' AS actor_type, 'arn:aws:iam::1:user/u' || user_id AS actor_name,
 'arn:' || (event_id % 50) AS resource_id, 'AWS::EC2' AS resource_type, '10.0.0.' || (event_id % 250) AS source_ip, 'us-east-1' AS region, CAST(user_id % 7 AS VARCHAR) AS account, event_type <> 'error' AS success,
 CASE WHEN event_type = 'error' THEN 'AccessDenied' END AS error_code, CASE WHEN event_type = 'error' THEN 'no' END AS error_message FROM events"""
AZURE_SQL = f"""SELECT 'z' || event_id AS id, 'azure' AS provider, {AZURE_TYPE} AS event_type, {AZURE_NAME} AS event_name, {TS} AS ts, 'u' || user_id || '@example.com' AS actor_id, 'user' AS actor_type, 'u' || user_id || '@example.com' AS actor_name,
 '/vm/' || (event_id % 40) AS resource_id, 'vm' AS resource_type, CAST(NULL AS VARCHAR) AS source_ip, CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS account, event_type <> 'error' AND event_id % 9 <> 0 AS success, CAST(NULL AS VARCHAR) AS error_code, CAST(NULL AS VARCHAR) AS error_message FROM events"""
GCP_SQL = f"""SELECT 'g' || event_id AS id, 'gcp' AS provider, {GCP_TYPE} AS event_type, {GCP_NAME} AS event_name, {TS} AS ts, 'u' || user_id || '@example.com' AS actor_id, 'user' AS actor_type, 'u' || user_id || '@example.com' AS actor_name,
 'projects/' || (event_id % 30) AS resource_id, CAST(NULL AS VARCHAR) AS resource_type, CAST(NULL AS VARCHAR) AS source_ip, CAST(NULL AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS account, event_type <> 'error' AND event_id % 9 <> 0 AS success, CASE WHEN event_type = 'error' AND event_id % 9 <> 0 THEN '7' END AS error_code, CAST(NULL AS VARCHAR) AS error_message FROM events"""


def shown(df):
    return df.withColumn("ts", utc(F.col("ts"))).select(*OUT)


@query("norm_aws_event", AWS_SQL)
def _(spark, sf):
    return shown(C.norm_aws_event(raw(spark, sf, AWS_RAW)))


@query("norm_azure_event", AZURE_SQL)
def _(spark, sf):
    return shown(C.norm_azure_event(raw(spark, sf, AZURE_RAW)))


@query("norm_gcp_event", GCP_SQL)
def _(spark, sf):
    return shown(C.norm_gcp_event(raw(spark, sf, GCP_RAW)))


def all_cloud_events(spark, sf):
    aws, azure, gcp = C.norm_aws_event(raw(spark, sf, AWS_RAW)), C.norm_azure_event(raw(spark, sf, AZURE_RAW)), C.norm_gcp_event(raw(spark, sf, GCP_RAW))
    return aws.unionByName(azure).unionByName(gcp)


@query(
    "cloud_event_type",
    f"""SELECT 'e' || event_id AS id, CASE event_id % 6 WHEN 0 THEN 'iam:user:create' WHEN 1 THEN 'compute:instance:create' WHEN 3 THEN 'compute:instance:stop' WHEN 4 THEN 'iam:policy:attach' ELSE {AWS_NAME} END AS kind FROM events
    UNION ALL SELECT 'z' || event_id, CASE event_id % 3 WHEN 0 THEN 'compute:instance:create' WHEN 1 THEN 'storage:account:delete' ELSE {AZURE_NAME} END FROM events
    UNION ALL SELECT 'g' || event_id, CASE event_id % 4 WHEN 0 THEN 'compute:instance:create' WHEN 1 THEN 'compute:instance:stop' WHEN 2 THEN 'storage:bucket:create' ELSE {GCP_NAME} END FROM events""",
)
def _(spark, sf):
    return all_cloud_events(spark, sf).select("id", C.cloud_event_type(F.col("provider"), F.col("event_name")).alias("kind"))


@query(
    "cloud_event_summary",
    f"""WITH ev AS ({AWS_SQL} UNION ALL {AZURE_SQL} UNION ALL {GCP_SQL}), g AS (
    SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(event_type) = 0 THEN 'event_type' ELSE 'all' END AS dimension, coalesce(provider, event_type) AS key, count(*) AS total, count(*) FILTER (NOT success) AS failed
    FROM ev GROUP BY GROUPING SETS ((provider), (event_type), ())) SELECT *, failed > total // 2 AS high_failure_rate FROM g""",
)
def _(spark, sf):
    return C.cloud_event_summary(all_cloud_events(spark, sf))


# assets ------------------------------------------------------------------
AWS_ASSET = (
    "concat('{\"InstanceId\":\"i-', " + vc("c_custkey") + ", '\",\"State\":{\"Name\":\"', CASE WHEN c_custkey % 3 = 0 THEN 'running' ELSE 'stopped' END, '\"},\"PrivateIpAddress\":\"10.0.0.1\"', CASE WHEN c_custkey % 4 = 0 THEN ',\"PublicIpAddress\":\"3.3.3.3\"' ELSE '' END, ',\"VpcId\":\"vpc-', "
    + vc("c_custkey % 5") + ", '\",\"SecurityGroups\":[', CASE c_custkey % 3 WHEN 0 THEN '{\"GroupId\":\"a\"},{\"GroupId\":\"b\"},{\"GroupId\":\"c\"},{\"GroupId\":\"d\"}' WHEN 1 THEN '{\"GroupId\":\"a\"},{\"GroupId\":\"b\"},{\"GroupId\":\"c\"}' ELSE '{\"GroupId\":\"a\"}' END, ']"
    + ",\"Tags\":[{\"Key\":\"team\",\"Value\":\"', c_mktsegment, '\"},{\"Key\":\"team\",\"Value\":\"t', " + vc("c_nationkey") + ", '\"}', CASE WHEN c_custkey % 2 = 0 THEN concat(',{\"Key\":\"Name\",\"Value\":\"', c_name, '\"}') ELSE '' END, ']', CASE WHEN c_custkey % 5 = 0 THEN ',\"IamInstanceProfile\":{\"Arn\":\"arn:role\"}' ELSE '' END, '}')"
)
AZURE_ASSET = (
    "concat('{\"id\":\"/vm/', " + vc("s_suppkey") + ", '\",\"name\":\"', s_name, '\",\"location\":\"westeurope\",\"tags\":{\"environment\":\"', CASE WHEN s_suppkey % 2 = 0 THEN 'Production' ELSE 'dev' END, '\"}', CASE s_suppkey % 3 WHEN 0 THEN ',\"properties\":{\"provisioningState\":\"Succeeded\",\"timeCreated\":\"2024-01-02T03:04:05Z\"}' WHEN 1 THEN ',\"properties\":{\"provisioningState\":\"Failed\"}' ELSE '' END, '}')"
)
GCP_ASSET = (
    "concat('{\"id\":\"', " + vc("p_partkey") + ", '\",\"name\":\"', p_name, '\",\"zone\":\"zone-', " + vc("p_size % 4") + ", '\",\"status\":\"', CASE WHEN p_size % 2 = 0 THEN 'RUNNING' ELSE 'TERMINATED' END, '\",\"labels\":{\"brand\":\"', p_brand, '\"},\"creationTimestamp\":\"2024-02-03T04:05:06Z\",\"networkInterfaces\":[{\"networkIP\":\"10.1.0.', " + vc("p_partkey % 250") + ", '\"', CASE WHEN p_partkey % 4 = 0 THEN ',\"accessConfigs\":[{\"natIP\":\"4.4.4.4\"},{\"natIP\":\"5.5.5.5\"}]' ELSE '' END, '}]', CASE WHEN p_partkey % 5 = 0 THEN concat(',\"serviceAccounts\":[{\"email\":\"svc@example.com\",\"scopes\":[\"s1\",\"s2\"', CASE WHEN p_partkey % 10 = 0 THEN ',\"s3\",\"s4\",\"s5\",\"s6\"' ELSE '' END, ']}]') ELSE '' END, '}')"
)

ASSETS = """assets AS (SELECT 'aws' AS provider, 'ec2' AS type, 'aws:ec2:i-' || c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'i-' || c_custkey END AS name, NULL AS region, CASE WHEN c_custkey % 3 = 0 THEN 'running' ELSE 'stopped' END AS state,
  CASE WHEN c_custkey % 4 = 0 THEN '3.3.3.3' END AS public_ip, 'vpc-' || (c_custkey % 5) AS vpc, [4, 3, 1][1 + c_custkey % 3] AS groups, CASE WHEN c_custkey % 5 = 0 THEN 'arn:role' END AS iam_role, 't' || c_nationkey AS tag, false AS prod, 0 AS scopes, '10.0.0.1' AS private_ip, 'a1' AS account, NULL AS created FROM customer
 UNION ALL SELECT 'azure', 'vm', 'azure:vm:/vm/' || s_suppkey, s_name, 'westeurope', CASE s_suppkey % 3 WHEN 0 THEN 'Succeeded' WHEN 1 THEN 'Failed' ELSE 'unknown' END, NULL, NULL, NULL, NULL, CASE WHEN s_suppkey % 2 = 0 THEN 'Production' ELSE 'dev' END, s_suppkey % 2 = 0, 0, NULL, 'sub', CASE WHEN s_suppkey % 3 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' END FROM supplier
 UNION ALL SELECT 'gcp', 'compute-instance', 'gcp:compute:' || p_partkey, p_name, 'zone-' || (p_size % 4), CASE WHEN p_size % 2 = 0 THEN 'running' ELSE 'terminated' END, CASE WHEN p_partkey % 4 = 0 THEN '4.4.4.4' END, NULL, NULL, CASE WHEN p_partkey % 5 = 0 THEN 'svc@example.com' END, p_brand, false, CASE WHEN p_partkey % 10 = 0 THEN 6 WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END, '10.1.0.' || (p_partkey % 250), 'proj', TIMESTAMP '2024-02-03 04:05:06' FROM part)"""
SCORED = """scored AS (SELECT *, CASE WHEN public_ip IS NOT NULL THEN 30 ELSE 0 END + CASE WHEN state IN ('running', 'Succeeded') THEN 10 ELSE 0 END + CASE WHEN iam_role IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN coalesce(groups, 0) > 2 THEN 10 ELSE 0 END + CASE WHEN prod OR scopes > 5 THEN 15 ELSE 0 END AS risk_score FROM assets)"""


def assets(spark, sf):
    aws = C.norm_asset(raw(spark, sf, AWS_ASSET, "customer"), "aws", account="a1")
    azure = C.norm_asset(raw(spark, sf, AZURE_ASSET, "supplier"), "azure", account="sub")
    return aws.unionByName(azure).unionByName(C.norm_asset(raw(spark, sf, GCP_ASSET, "part"), "gcp", account="proj"))


@query("norm_asset", f"WITH {ASSETS} SELECT provider, type, id, name, region, account, state, private_ip, public_ip, vpc, CAST(groups AS VARCHAR) AS groups, iam_role, scopes, tag, created FROM assets")
def _(spark, sf):
    tag = F.coalesce(F.col("tags")["team"], F.col("tags")["environment"], F.col("tags")["brand"])
    groups = F.when(F.col("security_groups").isNotNull(), F.size("security_groups").cast("string"))
    scopes = F.when(F.col("permissions").isNull(), 0).otherwise(F.size("permissions"))
    listed = ("provider", "type", "id", "name", "region", "account", "state", "private_ip", "public_ip", "vpc")
    return assets(spark, sf).select(*listed, groups.alias("groups"), "iam_role", scopes.alias("scopes"), tag.alias("tag"), utc(F.col("created_at")).alias("created"))


@query("asset_risk", f"WITH {ASSETS}, {SCORED} SELECT id, risk_score FROM scored")
def _(spark, sf):
    return assets(spark, sf).transform(C.asset_risk).select("id", "risk_score")


@query(
    "asset_risk_factors",
    f"""WITH {ASSETS} SELECT id, array_to_string(list_filter([CASE WHEN public_ip IS NOT NULL THEN CASE provider WHEN 'gcp' THEN 'External IP Address' ELSE 'Public IP Address' END END, CASE WHEN iam_role IS NOT NULL THEN CASE provider WHEN 'gcp' THEN 'Service Account Attached' ELSE 'IAM Role Attached' END END, CASE WHEN groups > 3 THEN 'Multiple Security Groups' END,
    CASE WHEN prod THEN 'Production Environment' END, CASE WHEN scopes > 5 THEN 'Broad IAM Scopes' END, CASE WHEN state = 'running' AND public_ip IS NOT NULL THEN CASE provider WHEN 'gcp' THEN 'Internet-Accessible Instance' ELSE 'Internet-Facing Instance' END END], lambda x: x IS NOT NULL), ',') AS factors FROM assets""",
)
def _(spark, sf):
    return assets(spark, sf).transform(C.asset_risk_factors).select("id", F.array_join("risk_factors", ",").alias("factors"))


@query("asset_filter", f"WITH {ASSETS}, {SCORED} SELECT id, risk_score FROM scored WHERE provider = 'aws' AND type = 'ec2' AND risk_score BETWEEN 30 AND 60 AND tag = 't3'")
def _(spark, sf):
    risky = assets(spark, sf).transform(C.asset_risk)
    return risky.transform(C.asset_filter(provider="aws", type="ec2", min_risk=30, max_risk=60, tags={"team": "t3"})).select("id", "risk_score")


@query(
    "asset_stats",
    f"""WITH {ASSETS} SELECT CASE WHEN grouping(provider) = 0 THEN 'provider' WHEN grouping(type) = 0 THEN 'type' ELSE 'all' END AS dimension, coalesce(provider, type) AS key, count(*) AS assets FROM assets GROUP BY GROUPING SETS ((provider), (type), ())""",
)
def _(spark, sf):
    return C.asset_stats(assets(spark, sf))


# graphs ------------------------------------------------------------------
EDGES = """edges AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey + 7) % 25) FROM nation),
 links AS (SELECT DISTINCT * FROM (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges))"""


def node(prefix, col):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def edges(spark, sf):
    n = table(spark, sf, "nation")
    ring = F.concat(F.lit("n"), ((F.col("n_nationkey") + 7) % 25).cast("string"))
    parts = [
        table(spark, sf, "customer").select(node("c", "c_custkey"), node("n", "c_nationkey")),
        table(spark, sf, "supplier").select(node("s", "s_suppkey"), node("n", "s_nationkey")),
        n.select(node("n", "n_nationkey"), node("r", "n_regionkey")),
        n.select(node("n", "n_nationkey"), ring),
    ]
    whole = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return whole.toDF("from_id", "to_id")


def regions(spark, sf):
    return table(spark, sf, "region").select(node("r", "r_regionkey").alias("id"))


def known_assets(spark, sf):
    c, s = table(spark, sf, "customer").select(node("c", "c_custkey").alias("id")), table(spark, sf, "supplier").select(node("s", "s_suppkey").alias("id"))
    return c.union(s).union(regions(spark, sf))


KNOWN = "known AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier UNION ALL SELECT 'r' || r_regionkey FROM region)"


def _reach(depth):
    return f"""WITH RECURSIVE {EDGES}, {KNOWN}, walk AS (SELECT 'r' || r_regionkey AS s, 'r' || r_regionkey AS id, 0 AS d FROM region UNION SELECT s, b, d + 1 FROM walk JOIN links ON id = a WHERE d < {depth}),
    near AS (SELECT s AS start_id, id, min(d) AS distance FROM walk GROUP BY 1, 2)"""


@query("graph_connected", _reach(2) + " SELECT start_id, id, distance FROM near SEMI JOIN known USING (id)")
def _(spark, sf):
    return G.graph_connected(regions(spark, sf), edges(spark, sf), 2, known_assets(spark, sf))


@query(
    "blast_radius",
    _reach(10) + """ SELECT start_id, count(*) AS blast_radius, CASE WHEN count(*) > 100 THEN 'critical' WHEN count(*) > 50 THEN 'high' WHEN count(*) > 20 THEN 'medium' ELSE 'low' END AS severity FROM near SEMI JOIN known USING (id) GROUP BY 1""",
)
def _(spark, sf):
    return G.blast_radius(regions(spark, sf), edges(spark, sf), known_assets(spark, sf))


# every customer, supplier and region as a start; counts beyond 128 are estimates, so only what is exact is compared
@query(
    "blast_radius_of_all",
    f"""WITH RECURSIVE {EDGES}, {KNOWN}, walk AS (SELECT id AS s, id, 0 AS d FROM known UNION SELECT s, b, d + 1 FROM walk JOIN links ON id = a WHERE d < 2),
    counted AS (SELECT s AS start_id, count(DISTINCT id) AS n FROM walk SEMI JOIN known USING (id) GROUP BY 1)
    SELECT start_id, CASE WHEN n <= 128 THEN n ELSE -1 END AS blast_radius, CASE WHEN n > 100 THEN 'critical' WHEN n > 50 THEN 'high' WHEN n > 20 THEN 'medium' ELSE 'low' END AS severity FROM counted""",
)
def _(spark, sf):
    found = G.blast_radius_of_all(edges(spark, sf), known_assets(spark, sf), depth=2)
    return found.select("start_id", F.when(F.col("exact"), F.col("blast_radius")).otherwise(F.lit(-1)).cast("long").alias("blast_radius"), "severity")


@query(
    "graph_paths",
    f"""WITH RECURSIVE {EDGES}, pairs AS (SELECT 'r' || ((n_nationkey * 2) % 5) AS f, 'n' || n_nationkey AS t FROM nation),
    p AS (SELECT f, t, [f] AS path FROM pairs UNION ALL SELECT f, t, list_append(path, b) FROM p JOIN links ON path[-1] = a WHERE path[-1] <> t AND len(path) < 5 AND NOT list_contains(path, b))
    SELECT f AS from_id, t AS to_id, array_to_string(path, '>') AS path FROM p WHERE path[-1] = t""",
)
def _(spark, sf):
    slot = F.concat(F.lit("r"), ((F.col("n_nationkey") * 2) % 5).cast("string"))
    pairs = table(spark, sf, "nation").select(slot.alias("from_id"), node("n", "n_nationkey").alias("to_id"))
    return G.graph_paths(pairs, edges(spark, sf), 5).withColumn("path", F.array_join("path", ">"))


NODES = """nodes AS (SELECT id, arg_max(type, ts) AS type, CASE arg_max(type, ts) WHEN 'system' THEN 'verified' ELSE 'reputable' END AS level, max(ts) AS last_seen FROM (SELECT source AS id, 'system' AS type, ts FROM sec UNION ALL SELECT user_name, 'user', ts FROM sec WHERE user_name IS NOT NULL) GROUP BY 1)"""


@query("trust_nodes", W + f", {NODES} SELECT * FROM nodes")
def _(spark, sf):
    return G.trust_nodes(sec_events(spark, sf), user="user_name").withColumn("last_seen", utc(F.col("last_seen")))


@query("trust_edges", W + "SELECT user_name AS from_id, source AS to_id, 'produced' AS action, 'reputable' AS level, count(*) AS weight FROM sec WHERE user_name IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    return G.trust_edges(sec_events(spark, sf), user="user_name", weighted=True)


@query(
    "trust_summary",
    W + f""", {NODES} SELECT 'level:' || level AS metric, count(*) AS value FROM nodes GROUP BY 1 UNION ALL SELECT 'total_nodes', count(*) FROM nodes UNION ALL SELECT 'total_edges', count(*) FROM sec WHERE user_name IS NOT NULL""",
)
def _(spark, sf):
    e = sec_events(spark, sf)
    return G.trust_summary(G.trust_nodes(e, user="user_name"), G.trust_edges(e, user="user_name"))
