"""Cloud audit records and assets of three providers in one form, with risk scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Record schemas and event-type names of the providers.
AWS_EVENT = (
    "eventID string, eventName string, eventTime string, userIdentity struct<principalId:string,type:string,arn:string>, "
    "resources array<struct<ARN:string,type:string>>, sourceIPAddress string, userAgent string, awsRegion string, "
    "recipientAccountId string, errorCode string, errorMessage string"
)
AZURE_EVENT = (
    "eventDataId string, operationName string, eventTimestamp string, caller string, resourceId string, resourceType string, "
    "status struct<value:string>"
)
GCP_EVENT = (
    "insertId string, timestamp string, protoPayload struct<methodName:string,authenticationInfo:struct<principalEmail:string>,"
    "resourceName:string,status:struct<code:double>>"
)
AWS_ASSET = (
    "InstanceId string, State struct<Name:string>, PrivateIpAddress string, PublicIpAddress string, VpcId string, "
    "SecurityGroups array<struct<GroupId:string>>, Tags array<struct<Key:string,Value:string>>, IamInstanceProfile struct<Arn:string>, LaunchTime string"
)
AZURE_ASSET = "id string, name string, location string, tags map<string,string>, properties struct<provisioningState:string,timeCreated:string>"
GCP_ASSET = (
    "id string, name string, zone string, status string, labels map<string,string>, creationTimestamp string, "
    "networkInterfaces array<struct<networkIP:string,accessConfigs:array<struct<natIP:string>>>>, serviceAccounts array<struct<email:string,scopes:array<string>>>"
)

AWS_TYPES = {
    "createuser": "iam:user:create",
    "deleteuser": "iam:user:delete",
    "attachuserpolicy": "iam:policy:attach",
    "runinstances": "compute:instance:create",
    "terminateinstances": "compute:instance:delete",
    "stopinstances": "compute:instance:stop",
    "putbucket": "storage:bucket:create",
    "deletebucket": "storage:bucket:delete",
}
AZURE_TYPES = {
    "microsoft.compute/virtualmachines/write": "compute:instance:create",
    "microsoft.compute/virtualmachines/delete": "compute:instance:delete",
    "microsoft.storage/storageaccounts/write": "storage:account:create",
}
GCP_TYPES = {
    "compute.instances.insert": "compute:instance:create",
    "compute.instances.delete": "compute:instance:delete",
    "storage.buckets.create": "storage:bucket:create",
}
AWS_EXACT_TYPES = {
    "RunInstances": "compute:instance:create",
    "TerminateInstances": "compute:instance:delete",
    "StopInstances": "compute:instance:stop",
    "StartInstances": "compute:instance:start",
    "CreateUser": "iam:user:create",
    "DeleteUser": "iam:user:delete",
    "AttachUserPolicy": "iam:policy:attach",
    "CreateBucket": "storage:bucket:create",
    "DeleteBucket": "storage:bucket:delete",
}
AZURE_WIDE_TYPES = AZURE_TYPES | {"microsoft.storage/storageaccounts/delete": "storage:account:delete"}
GCP_WIDE_TYPES = GCP_TYPES | {
    "compute.instances.stop": "compute:instance:stop",
    "compute.instances.start": "compute:instance:start",
    "storage.buckets.delete": "storage:bucket:delete",
}


def _by_part(name: Column, types: dict[str, str]) -> Column:
    """Type of the first listed part that the name contains, else the name itself."""
    lower = F.lower(name)
    result = name
    for part, kind in reversed(types.items()):
        result = F.when(lower.contains(part), kind).otherwise(result)
    return result


def cloud_event_type(provider: Column, name: Column) -> Column:
    """Generic type by provider: exact names for AWS, contained parts for Azure and GCP."""
    exact = name
    for key, kind in AWS_EXACT_TYPES.items():
        exact = F.when(name == key, kind).otherwise(exact)
    azure, gcp = _by_part(name, AZURE_WIDE_TYPES), _by_part(name, GCP_WIDE_TYPES)
    return F.when(provider == "aws", exact).when(provider == "azure", azure).when(provider == "gcp", gcp).otherwise(name)


EVENT_COLUMNS = [
    "id", "provider", "event_type", "event_name", "ts", "actor_id", "actor_type", "actor_name", "resource_id",
    "resource_type", "source_ip", "user_agent", "region", "account", "success", "error_code", "error_message",
    "raw_event",
]


def _event(df: DataFrame, raw: str, provider: str, **columns: Column) -> DataFrame:
    columns |= {"provider": F.lit(provider), "raw_event": F.col(raw)}
    return df.select(*[columns.get(c, F.lit(None).cast("string")).alias(c) for c in EVENT_COLUMNS])


def _when(col: Column) -> Column:
    return F.try_to_timestamp(col)


def norm_aws_event(df: DataFrame, raw: str = "value") -> DataFrame:
    """CloudTrail JSON; success means there is no error code; the first resource counts."""
    rows = df.withColumn("_j", F.from_json(raw, AWS_EVENT))
    j = F.col("_j")
    first = F.get(j["resources"], 0)
    return _event(
        rows,
        raw,
        "aws",
        id=j["eventID"],
        event_name=j["eventName"],
        event_type=_by_part(j["eventName"], AWS_TYPES),
        ts=_when(j["eventTime"]),
        actor_id=j["userIdentity"]["principalId"],
        actor_type=j["userIdentity"]["type"],
        actor_name=j["userIdentity"]["arn"],
        resource_id=first["ARN"],
        resource_type=first["type"],
        source_ip=j["sourceIPAddress"],
        user_agent=j["userAgent"],
        region=j["awsRegion"],
        account=j["recipientAccountId"],
        success=j["errorCode"].isNull(),
        error_code=j["errorCode"],
        error_message=F.when(j["errorCode"].isNotNull(), j["errorMessage"]),
    )


def norm_azure_event(df: DataFrame, raw: str = "value") -> DataFrame:
    """Activity-log JSON; success means the status value is `succeeded` in any case."""
    rows = df.withColumn("_j", F.from_json(raw, AZURE_EVENT))
    j = F.col("_j")
    return _event(
        rows,
        raw,
        "azure",
        id=j["eventDataId"],
        event_name=j["operationName"],
        event_type=_by_part(j["operationName"], AZURE_TYPES),
        ts=_when(j["eventTimestamp"]),
        actor_id=j["caller"],
        actor_name=j["caller"],
        actor_type=F.when(j["caller"].isNotNull(), "user"),
        resource_id=j["resourceId"],
        resource_type=j["resourceType"],
        success=F.coalesce(F.lower(j["status"]["value"]) == "succeeded", F.lit(False)),
    )


def norm_gcp_event(df: DataFrame, raw: str = "value") -> DataFrame:
    """Audit-log JSON; success means status code 0, and a missing status counts as failure."""
    rows = df.withColumn("_j", F.from_json(raw, GCP_EVENT))
    p = F.col("_j")["protoPayload"]
    code, mail = p["status"]["code"], p["authenticationInfo"]["principalEmail"]
    return _event(
        rows,
        raw,
        "gcp",
        id=F.col("_j")["insertId"],
        event_name=p["methodName"],
        event_type=_by_part(p["methodName"], GCP_TYPES),
        ts=_when(F.col("_j")["timestamp"]),
        actor_id=mail,
        actor_name=mail,
        actor_type=F.when(mail.isNotNull(), "user"),
        resource_id=p["resourceName"],
        success=F.coalesce(code == 0, F.lit(False)),
        error_code=F.when(code != 0, code.cast("long").cast("string")),
    )


ASSET_TYPES = {
    "provider": "string",
    "id": "string",
    "type": "string",
    "name": "string",
    "region": "string",
    "account": "string",
    "tags": "map<string,string>",
    "state": "string",
    "private_ip": "string",
    "public_ip": "string",
    "vpc": "string",
    "security_groups": "array<string>",
    "iam_role": "string",
    "permissions": "array<string>",
    "created_at": "timestamp",
    "raw_metadata": "string",
}


def _asset(df: DataFrame, raw: str, provider: str, kind: str, **columns: Column) -> DataFrame:
    columns |= {"provider": F.lit(provider), "type": F.lit(kind), "raw_metadata": F.col(raw)}
    return df.select(*[columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in ASSET_TYPES.items()])


def norm_asset(df: DataFrame, provider: str, raw: str = "value", account: str | None = None, region: str | None = None) -> DataFrame:
    """EC2 instance, Azure VM or GCP instance JSON as one asset schema.

    `account` (project, subscription) and the `region` of EC2 instances are those that the list was read from.
    Of several network interfaces, external addresses and service accounts the first counts; an Azure VM
    without a provisioning state is `unknown`, and its record names no addresses.
    """
    schema = {"aws": AWS_ASSET, "azure": AZURE_ASSET, "gcp": GCP_ASSET}[provider]
    rows = df.withColumn("_j", F.from_json(raw, schema))
    j, owner = F.col("_j"), F.lit(account)
    if provider == "azure":
        return _asset(
            rows,
            raw,
            provider,
            "vm",
            id=F.concat(F.lit("azure:vm:"), j["id"]),
            name=j["name"],
            region=j["location"],
            account=owner,
            state=F.coalesce(j["properties"]["provisioningState"], F.lit("unknown")),
            tags=F.coalesce(j["tags"], F.create_map()),
            created_at=F.try_to_timestamp(j["properties"]["timeCreated"]),
        )
    if provider == "gcp":
        interface, service = F.get(j["networkInterfaces"], 0), F.get(j["serviceAccounts"], 0)
        return _asset(
            rows,
            raw,
            provider,
            "compute-instance",
            id=F.concat(F.lit("gcp:compute:"), j["id"]),
            name=j["name"],
            region=j["zone"],
            account=owner,
            state=F.lower(j["status"]),
            tags=F.coalesce(j["labels"], F.create_map()),
            private_ip=interface["networkIP"],
            public_ip=F.get(interface["accessConfigs"], 0)["natIP"],
            iam_role=service["email"],
            permissions=service["scopes"],
            created_at=F.try_to_timestamp(j["creationTimestamp"]),
        )
    listed = F.coalesce(F.filter(j["Tags"], lambda t: t["Key"].isNotNull() & t["Value"].isNotNull()), F.array().cast("array<struct<Key:string,Value:string>>"))
    # of equal keys the last entry counts
    final = F.filter(listed, lambda t, i: ~F.exists(F.slice(listed, i + 2, F.size(listed)), lambda u: u["Key"] == t["Key"]))
    tags = F.map_from_entries(F.transform(final, lambda t: F.struct(t["Key"], t["Value"])))
    groups = F.filter(F.transform(j["SecurityGroups"], lambda g: g["GroupId"]), lambda g: g.isNotNull())
    return _asset(
        rows,
        raw,
        provider,
        "ec2",
        id=F.concat(F.lit("aws:ec2:"), j["InstanceId"]),
        name=F.coalesce(tags["Name"], j["InstanceId"]),
        state=j["State"]["Name"],
        private_ip=j["PrivateIpAddress"],
        public_ip=j["PublicIpAddress"],
        vpc=j["VpcId"],
        security_groups=groups,
        iam_role=j["IamInstanceProfile"]["Arn"],
        tags=tags,
        account=owner,
        region=F.lit(region),
        created_at=F.try_to_timestamp(j["LaunchTime"]),
    )


def _given(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def _more(name: str, n: int) -> Column:
    return F.coalesce(F.size(name) > n, F.lit(False))


def _state(value: str) -> Column:
    return F.coalesce(F.col("state") == value, F.lit(False))


def _production() -> Column:
    return F.coalesce(F.lower(F.col("tags")["environment"]) == "production", F.lit(False))


def asset_risk(df: DataFrame) -> DataFrame:
    """Add `risk_score`: points per exposure by provider, at most 100."""
    p = F.col("provider")
    # fixed values: points per exposure
    points = [
        (_given("public_ip"), 30),
        (p.isin("aws", "gcp") & _state("running"), 10),
        ((p == "azure") & F.coalesce(F.lower("state") == "succeeded", F.lit(False)), 10),
        (p.isin("aws", "gcp") & _given("iam_role"), 20),
        ((p == "aws") & _more("security_groups", 2), 10),
        ((p == "azure") & _production(), 15),
        ((p == "gcp") & _more("permissions", 5), 15),
    ]
    total = reduce(lambda a, b: a + b, [F.when(test, n).otherwise(0) for test, n in points])
    return df.withColumn("risk_score", F.least(F.lit(100), total))


def asset_risk_factors(df: DataFrame) -> DataFrame:
    """Add `risk_factors`: what makes an asset risky, as text."""
    p, public = F.col("provider"), _given("public_ip")
    # fixed values: texts of the factors
    facts = [
        ((p == "aws") & public, "Public IP Address"),
        ((p == "azure") & public, "Public Endpoint"),
        ((p == "gcp") & public, "External IP Address"),
        ((p == "aws") & _given("iam_role"), "IAM Role Attached"),
        ((p == "gcp") & _given("iam_role"), "Service Account Attached"),
        ((p == "aws") & _more("security_groups", 3), "Multiple Security Groups"),
        ((p == "azure") & _production(), "Production Environment"),
        ((p == "gcp") & _more("permissions", 5), "Broad IAM Scopes"),
        ((p == "aws") & _state("running") & public, "Internet-Facing Instance"),
        ((p == "gcp") & _state("running") & public, "Internet-Accessible Instance"),
    ]
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in facts]), lambda x: x.isNotNull())
    return df.withColumn("risk_factors", found)


def asset_filter(provider=None, type=None, region=None, account=None, min_risk: int = 0, max_risk: int = 0, tags: dict[str, str] | None = None):
    """Assets that meet every given criterion; risk bounds of 0 are unset."""

    def apply(df: DataFrame) -> DataFrame:
        for name, value in (("provider", provider), ("type", type), ("region", region), ("account", account)):
            if value:
                df = df.where(F.col(name) == value)
        if min_risk > 0:
            df = df.where(F.col("risk_score") >= min_risk)
        if max_risk > 0:
            df = df.where(F.col("risk_score") <= max_risk)
        for key, value in (tags or {}).items():
            df = df.where(F.coalesce(F.col("tags")[key], F.lit("")) == value)
        return df

    return apply


def _grouped(df: DataFrame, names: list[str]):
    """One pass over the data for the grand total and each name by itself."""
    return df.groupingSets([[F.col(n)] for n in names] + [[]], *[F.col(n) for n in names])


def _labelled(grouped: DataFrame, names: list[str]) -> DataFrame:
    """`dimension` and `key` from the grouping id, whose leftmost bit belongs to the first name."""
    dimension = F.lit("all")
    key = F.lit(None).cast("string")
    for place, n in enumerate(names):
        mask = (1 << len(names)) - 1 - (1 << (len(names) - 1 - place))
        dimension = F.when(F.col("_g") == mask, n).otherwise(dimension)
        key = F.when(F.col("_g") == mask, F.col(n).cast("string")).otherwise(key)
    rest = [c for c in grouped.columns if c not in (*names, "_g")]
    return grouped.select(dimension.alias("dimension"), key.alias("key"), *rest)


def cloud_event_summary(events: DataFrame) -> DataFrame:
    """Totals and failures overall, by provider and by type, and whether failures exceed half (whole division)."""
    names = ["provider", "event_type"]
    counted = _grouped(events, names).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce(F.col("success"), F.lit(False))).alias("failed")
    )
    return _labelled(counted, names).withColumn("high_failure_rate", F.col("failed") > F.floor(F.col("total") / 2))


def asset_stats(assets: DataFrame) -> DataFrame:
    """Asset counts overall, by provider and by type."""
    names = ["provider", "type"]
    return _labelled(_grouped(assets, names).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("assets")), names)
