"""Standard events from raw envelopes: dispatch by vendor, base fields, quality, contract, routing and public views.

One pass of column expressions over the raw rows; each payload is parsed once (a
file shipper's record a second time, for the original line that it carries).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.values import first_failing, piped_id

# Windows security event ids -> domain, category, action, outcome (None: from the status), type.
WINDOWS_EVENTS = [
    ("1102", "iam", "iam", "security-log-cleared", "success", "iam.security-log-cleared"),
    ("4624", "authentication", "authentication", "logon-success", "success", "authentication.logon-success"),
    ("4625", "authentication", "authentication", "logon-failure", "failure", "authentication.logon-failure"),
    ("4634", "session", "session", "logoff", "success", "session.logoff"),
    ("4647", "session", "session", "logoff", "success", "session.logoff"),
    ("4648", "authentication", "authentication", "explicit-credentials-use", "success", "authentication.explicit-credentials-use"),
    ("4662", "directory", "iam", "directory-object-access", "success", "directory.object-access"),
    ("4672", "authentication", "authentication", "special-privileges-assigned", "success", "authentication.special-privileges-assigned"),
    ("4673", "directory", "iam", "privileged-service-call", "success", "directory.privileged-service-call"),
    ("4719", "iam", "iam", "audit-policy-change", "success", "iam.audit-policy-change"),
    ("4720", "iam", "iam", "user-create", "success", "iam.user-create"),
    ("4722", "iam", "iam", "user-enable", "success", "iam.user-enable"),
    ("4723", "iam", "iam", "password-change", "success", "iam.password-change"),
    ("4724", "iam", "iam", "password-reset", "success", "iam.password-reset"),
    ("4725", "iam", "iam", "user-disable", "success", "iam.user-disable"),
    ("4726", "iam", "iam", "user-delete", "success", "iam.user-delete"),
    ("4728", "directory", "iam", "group-member-add", "success", "directory.group-member-add"),
    ("4729", "directory", "iam", "group-member-remove", "success", "directory.group-member-remove"),
    ("4732", "directory", "iam", "group-member-add", "success", "directory.group-member-add"),
    ("4733", "directory", "iam", "group-member-remove", "success", "directory.group-member-remove"),
    ("4756", "directory", "iam", "group-member-add", "success", "directory.group-member-add"),
    ("4757", "directory", "iam", "group-member-remove", "success", "directory.group-member-remove"),
    ("4768", "authentication", "authentication", "credential-validation", None, "authentication.credential-validation"),
    ("4769", "authentication", "authentication", "credential-validation", None, "authentication.credential-validation"),
    ("4771", "authentication", "authentication", "kerberos-preauth-failure", "failure", "authentication.kerberos-preauth-failure"),
    ("4776", "authentication", "authentication", "credential-validation", None, "authentication.credential-validation"),
]
#: Ids whose account is the target of the event, and those that change a group's members.
# Event ids whose target is the user, ids that change a group, domains of events; the codes of validate_events are such values, too.
TARGET_IS_USER = ("4624", "4625", "4634", "4723", "4724", "4768", "4769", "4771", "4776")
GROUP_CHANGES = ("4728", "4729", "4732", "4733", "4756", "4757")
DOMAINS = ("authentication", "session", "iam", "directory", "network", "dns", "web", "tls")
PAYLOAD = (
    "_bad string, `@timestamp` string, message string, agent struct<type:string>, event struct<dataset:string,original:string>, _path string, ts string, uid string, id struct<orig_h:string,orig_p:string,resp_h:string,resp_p:string>, "
    "`id.orig_h` string, `id.orig_p` string, `id.resp_h` string, `id.resp_p` string, orig_h string, orig_p string, resp_h string, resp_p string, proto string, service string, duration string, orig_bytes string, resp_bytes string, "
    "orig_pkts string, resp_pkts string, query string, rcode_name string, host string, uri string, method string, status_code string, server_name string, version string, cipher string, "
    "winlog struct<provider_name:string,channel:string,event_id:string,computer_name:string,record_id:string,time_created:string,event_data:map<string,string>>"
)
IPV4 = rf"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


#: Eight groups of up to four digits, or up to seven with one ``::``.
IPV6 = r"^(?=[0-9A-Fa-f:]+$)(?!.*[0-9A-Fa-f]{5})(?!.*:::)(?!.*::.*::)(?!:[^:])(?!.*[^:]:$)(?:(?=.*::)(?!:*(?:[0-9A-Fa-f]+:+){7}[0-9A-Fa-f])|(?!.*::)(?=(?:[0-9A-Fa-f]+:){7}[0-9A-Fa-f]+$)).*$"


def is_ip(c: Column) -> Column:
    """An IPv4 address without leading zeros, or an IPv6 address of eight groups or with one ``::`` for some of them.

    One test of c, as filters on error codes copy what they are made of.
    """
    return F.coalesce(c.rlike(f"{IPV4}|{IPV6}"), F.lit(False))


def text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def stamp(c: Column) -> Column:
    """RFC 3339 text as a time; null if it is none."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(c))


def unwrap_shipped(df: DataFrame) -> DataFrame:
    """df(vendor_dataset, payload) with body, the record itself, and error_code of payloads that are no JSON object or whose shipper's frame contradicts itself."""
    x = df.withColumn("outer", F.from_json("payload", PAYLOAD, {"columnNameOfCorruptRecord": "_bad"}))
    shipped = F.lower("outer.agent.type") == "filebeat"
    original = F.col("outer.event.original")
    x = x.withColumn("inner", F.when(shipped, F.from_json(original, PAYLOAD, {"columnNameOfCorruptRecord": "_bad"})).otherwise(F.col("outer")))
    frame = first_failing(
        (F.col("outer.event.dataset") == F.col("vendor_dataset"), "DIP_ZEEK_DATASET_MISMATCH"), ((original != "") & (F.col("outer.message") != ""), "DIP_ZEEK_ORIGINAL_MISSING"),
        (original == F.col("outer.message"), "DIP_ZEEK_ORIGINAL_MISMATCH"), (F.col("inner").isNotNull() & F.col("inner._bad").isNull() & F.ltrim(original).startswith("{"), "DIP_ZEEK_ORIGINAL_INVALID"),
    )
    valid = F.col("outer").isNotNull() & F.col("outer._bad").isNull() & F.ltrim("payload").startswith("{")
    code = F.when(~F.coalesce(valid, F.lit(False)), "DIP_JSON_INVALID").when((F.lower("vendor_name") == "zeek") & shipped, frame)
    return x.withColumn("error_code", code).withColumn("body", F.when(F.lower("vendor_name") == "zeek", F.col("inner")).otherwise(F.col("outer"))).drop("outer", "inner")


def whole(c: Column) -> Column:
    """A whole number that is not negative, also written as 12.0."""
    return F.when(c.rlike(r"^\d+(\.0+)?$"), F.regexp_replace(c, r"\.0+$", "").try_cast("long"))


def with_base_fields(df: DataFrame, semantic: Column, domain: Column) -> DataFrame:
    """Identity, provenance and storage generation of a standard event."""
    event_id = piped_id("evt", F.lit("event-v1"), F.col("raw_event_id").cast("string"), semantic)
    provenance = F.struct(F.col("raw_event_id").cast("string").alias("raw_event_id"), "release_id", F.lit("1.0.0").alias("dip_version"), F.lit("1.0.0").alias("uim_version"))
    return df.withColumn("event_id", event_id).withColumn("event_type", semantic).withColumn("domain", domain).withColumn("generation", F.lit("g1")).withColumn("schema_version", F.lit("1.0.0")).withColumn("provenance", provenance)


def quality_of(warnings: Column, domain: Column) -> Column:
    """struct(status, reasons, usable_for): partial if there is a warning; the domain's features are among what it can be used for."""
    return F.struct(F.when(F.size(warnings) > 0, "partial").otherwise("qualified").alias("status"), warnings.alias("reasons"), F.array(F.lit("event_query"), F.concat(domain, F.lit("_features"))).alias("usable_for"))


def normalize_windows(df: DataFrame) -> DataFrame:
    """Rows of df with a Windows payload as standard events, or an error_code; the table of event ids is fixed and sent to the tasks."""
    table = df.sparkSession.createDataFrame(WINDOWS_EVENTS, "code string, w_domain string, w_category string, w_action string, w_outcome string, w_type string")
    win, data = F.col("body.winlog"), lambda k: text(F.try_element_at(F.col("body.winlog.event_data"), F.lit(k)))
    x = df.withColumn("code", text(win["event_id"])).join(F.broadcast(table), "code", "left")
    code, domain = F.col("code"), F.col("w_domain")
    security = F.lower(win["provider_name"]) == "microsoft-windows-security-auditing"
    cleared = (code == "1102") & (F.lower(win["provider_name"]) == "microsoft-windows-eventlog")
    gate = (F.coalesce(security, F.lit(False)) | F.coalesce(cleared, F.lit(False))) & (F.lower(win["channel"]) == "security")
    time = F.coalesce(stamp(F.col("body.`@timestamp`")), stamp(win["time_created"]))
    actor = F.struct(data("SubjectUserSid").alias("id"), data("SubjectUserName").alias("name"))
    target = F.struct(F.coalesce(data("TargetUserSid"), data("TargetSid")).alias("id"), data("TargetUserName").alias("name"))
    changed, of_group = F.struct(data("MemberSid").alias("id"), data("MemberName").alias("name")), code.isin(*GROUP_CHANGES)
    own = F.when(code.isin(*TARGET_IS_USER), target).otherwise(actor)
    other = F.when(code == "4648", target).when(of_group, changed).when(domain.isin("directory", "iam") & ~code.isin(*TARGET_IS_USER), target)
    some = lambda s: F.when(s["id"].isNotNull() | s["name"].isNotNull(), s)
    x = x.withColumn("user", some(own)).withColumn("target", some(other)).withColumn("group", some(F.when(of_group, F.struct(data("TargetSid").alias("id"), data("TargetUserName").alias("name")))))
    nobody = F.col("user").isNull() & F.col("target").isNull()
    # an address is judged without the prefix in any case, and loses it in lower case only
    x = x.withColumn("_ip", F.nullif(data("IpAddress"), F.lit("-"))).withColumn("_judged", F.regexp_replace(F.lower("_ip"), "^::ffff:", ""))
    x = x.withColumn("_good_ip", F.coalesce(is_ip(F.col("_judged")), F.lit(False)))
    ip = F.col("_ip")
    warned = F.filter(F.array(F.when(nobody, "missing_user_identity"), F.when(ip.isNotNull() & ~F.col("_good_ip"), "invalid_source_ip")), lambda w: w.isNotNull())
    error = first_failing(
        (win.isNotNull(), "DIP_WINDOWS_WINLOG_MISSING"), (gate, "EVENT_UNSUPPORTED"), (code.isNotNull(), "DIP_WINDOWS_EVENT_ID_MISSING"), (time.isNotNull(), "UIM_EVENT_TIME_INVALID"),
        (text(win["computer_name"]).isNotNull(), "DIP_WINDOWS_COMPUTER_MISSING"), (domain.isNotNull(), "EVENT_UNSUPPORTED"), ((domain != "directory") | ~nobody, "UIM_ACTOR_REQUIRED"),
    )
    outcome = F.when(code.isin("4768", "4769", "4776"), F.when(data("Status").isin("0x0", "0"), "success").otherwise("failure")).otherwise(F.col("w_outcome"))
    x = x.withColumn("error_code", F.coalesce("error_code", error)).withColumn("event_time", time).withColumn("category", F.array("w_category")).withColumn("action", F.col("w_action")).withColumn("outcome", outcome)
    x = x.withColumn("host_name", text(win["computer_name"])).withColumn("source_ip", F.when(F.col("_good_ip"), F.regexp_replace(ip, "^::ffff:", ""))).withColumn("quality", quality_of(warned, domain))
    return with_base_fields(x, F.col("w_type"), domain).drop("w_domain", "w_category", "w_action", "w_outcome", "w_type", "_ip", "_judged", "_good_ip")


def normalize_sensor(df: DataFrame) -> DataFrame:
    """Rows of df with a network sensor's payload (connection, DNS, HTTP, TLS) as standard events, or an error_code.

    A lone ``-`` is no value.  The outcome is unknown but for HTTP rows with a status.
    The payload stays in its own column.
    """
    # each cleaned field is a column of its own, read by the rules below as it is
    said = lambda c: text(F.regexp_replace(c, "^-$", ""))
    plain = ["_path", "ts", "proto", "service", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "query", "rcode_name", "host", "uri", "method", "status_code", "server_name", "version", "cipher"]
    ends = ["orig_h", "resp_h", "orig_p", "resp_p"]
    either = [F.coalesce(said(F.col(f"body.`id.{k}`")), said(F.col(f"body.id.{k}")), said(F.col(f"body.`{k}`"))).alias(f"_f_{k}") for k in ends]
    df = df.select("*", *[said(F.col(f"body.`{k}`")).alias(f"_f_{k}") for k in plain], *either)
    b = lambda k: F.col(f"_f_{k}")
    # whole numbers as text, and whole numbers in any notation
    number = lambda k: F.when(b(k).rlike(r"^[+-]?\d+$"), b(k).try_cast("int")).alias(f"_n_{k}")
    counter = lambda k: F.when((b(k).try_cast("double") >= 0) & (b(k).try_cast("double") < 9.2e18) & (b(k).try_cast("double") % 1 == 0), F.coalesce(b(k).try_cast("long"), b(k).try_cast("double").cast("long"))).alias(f"_n_{k}")
    counted = ["orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts"]
    df = df.select("*", *[number(k) for k in ("orig_p", "resp_p", "status_code")], *[counter(k) for k in counted])
    declared, named = F.lower(b("_path")), F.nullif(F.lower(F.regexp_replace("vendor_dataset", "^zeek[.]", "")), F.lit(""))
    df = df.withColumn("_kind", F.coalesce(named, declared))
    kind, src, dst = F.col("_kind"), b("orig_h"), b("resp_h")
    port = lambda k: F.when(F.col(f"_n_{k}").between(0, 65535), F.col(f"_n_{k}"))
    lasted = b("duration").try_cast("double")
    seconds = b("ts").try_cast("double")
    time = F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")), stamp(F.col("body.`@timestamp`")))
    status = F.col("_n_status_code")
    pick = lambda conn, dns, http, ssl: F.when(kind == "conn", conn).when(kind == "dns", dns).when(kind == "http", http).when(kind == "ssl", ssl)
    domain = pick(F.lit("network"), F.lit("dns"), F.lit("web"), F.lit("tls"))
    semantic = pick(F.lit("network.connection"), F.lit("dns.response"), F.lit("web.request"), F.lit("tls.session"))
    action = pick(F.lit("network-connection"), F.lit("dns-response"), F.lit("http-request"), F.lit("tls-session"))
    error = first_failing(
        (declared.isNull() | named.isNull() | (declared == named), "DIP_ZEEK_DATASET_MISMATCH"), (kind.isin("conn", "dns", "http", "ssl"), "EVENT_UNSUPPORTED"), (time.isNotNull(), "UIM_EVENT_TIME_INVALID"),
        (is_ip(src) & is_ip(dst), "UIM_ZEEK_ENDPOINTS_REQUIRED"), ((kind != "dns") | b("query").isNotNull(), "UIM_DNS_QUERY_REQUIRED"), ((kind != "http") | b("host").isNotNull(), "UIM_HTTP_HOST_REQUIRED"),
        ((kind != "ssl") | b("server_name").isNotNull(), "UIM_TLS_SERVER_NAME_REQUIRED"),
    )
    warned = F.filter(F.array(F.when(F.col("body.uid").isNull(), "missing_source_session_id")), lambda w: w.isNotNull())
    x = df.withColumn("error_code", F.coalesce("error_code", error)).withColumn("event_time", time).withColumn("category", F.array(F.when(kind == "http", "web").otherwise("network"))).withColumn("action", action)
    x = x.withColumn("outcome", F.when((kind == "http") & status.isNotNull(), F.when(status >= 400, "failure").otherwise("success")).otherwise("unknown")).withColumn("source_ip", src).withColumn("source_port", port("orig_p")).withColumn("destination_ip", dst)
    x = x.withColumn("destination_port", port("resp_p")).withColumn("transport", F.lower(b("proto"))).withColumn("protocol", F.lower(b("service"))).withColumn("duration", F.when((kind == "conn") & (lasted >= 0) & (lasted < 9.2e9), (lasted * 1e9).cast("long")))
    x = x.withColumn("bytes", F.when(kind == "conn", F.try_add(F.col("_n_orig_bytes"), F.col("_n_resp_bytes")))).withColumn("packets", F.when(kind == "conn", F.try_add(F.col("_n_orig_pkts"), F.col("_n_resp_pkts"))))
    x = x.withColumn("name", pick(F.lit(None), b("query"), b("host"), b("server_name"))).withColumn("path", F.when(kind == "http", F.coalesce(b("uri"), F.lit("/")))).withColumn("status_code", F.when(kind == "http", status))
    x = x.withColumn("response_code", F.when(kind == "dns", b("rcode_name"))).withColumn("method", F.when(kind == "http", b("method"))).withColumn("version", F.when(kind == "ssl", b("version"))).withColumn("cipher", F.when(kind == "ssl", b("cipher")))
    x = with_base_fields(x.withColumn("quality", quality_of(warned, domain)), semantic, domain)
    return x.drop(*[c for c in x.columns if c.startswith(("_f_", "_n_"))], "_kind")


def validate_events(df: DataFrame) -> DataFrame:
    """df with the code of the first rule of the event contract that a row breaks, unless it has an error_code."""
    has = lambda *cs: F.lit(True) if not cs else text(F.col(cs[0])).isNotNull() & has(*cs[1:])
    d, q = F.col("domain"), F.col("quality")
    when = lambda domains, ok: ~d.isin(*domains) | ok
    broken = first_failing(
        (F.col("event_time").isNotNull() & has("organization_id", "event_id", "vendor_name", "vendor_product", "vendor_dataset") & (F.size("category") > 0), "UIM_COMMON_REQUIRED_FIELD_MISSING"),
        (d.isin(*DOMAINS), "UIM_DOMAIN_UNSUPPORTED"), (has("generation"), "UIM_ROUTE_MISMATCH"), (F.col("outcome").isNull() | F.col("outcome").isin("success", "failure", "unknown"), "UIM_EVENT_OUTCOME_INVALID"),
        (F.col("schema_version") == "1.0.0", "UIM_SCHEMA_VERSION_UNSUPPORTED"), (has("event_type"), "UIM_EVENT_TYPE_REQUIRED"), (has("provenance.raw_event_id", "provenance.release_id"), "UIM_PROVENANCE_REQUIRED"),
        (when(DOMAINS[:4], has("action", "outcome")), "UIM_EVENT_SEMANTICS_REQUIRED"), (when(("network",), has("transport", "source_ip", "destination_ip")), "UIM_NETWORK_ENDPOINTS_REQUIRED"),
        (when(("dns",), has("name")), "UIM_DNS_QUESTION_REQUIRED"), (when(("web",), has("name")), "UIM_WEB_DOMAIN_REQUIRED"), (when(("tls",), has("name")), "UIM_TLS_SERVER_NAME_REQUIRED"),
        (q["status"].isin("qualified", "partial"), "UIM_QUALITY_STATUS_INVALID"), ((F.size(q["usable_for"]) > 0) & ((q["status"] == "partial") == (F.size(q["reasons"]) > 0)), "UIM_QUALITY_DETAILS_INVALID"),
    )
    return df.withColumn("error_code", F.coalesce("error_code", broken))


def standard_events(raw: DataFrame) -> DataFrame:
    """Standard events and, with error_code, what goes to quarantine; raw(raw_event_id, organization_id, vendor_name, vendor_product, vendor_dataset, release_id, payload)."""
    x = unwrap_shipped(raw)
    vendor = F.lower("vendor_name")
    windows, sensor = normalize_windows(x.where(vendor == "microsoft")), normalize_sensor(x.where(vendor == "zeek"))
    other = x.where(~F.coalesce(vendor.isin("microsoft", "zeek"), F.lit(False))).withColumn("error_code", F.coalesce("error_code", F.lit("EVENT_UNSUPPORTED")))
    whole_ = windows.unionByName(sensor, allowMissingColumns=True)
    return validate_events(whole_).unionByName(other, allowMissingColumns=True).drop("body")


def route(events: DataFrame) -> DataFrame:
    """Valid events with the partition columns of their store: domain and UTC day."""
    return events.where(F.col("error_code").isNull() & F.col("domain").isin(*DOMAINS)).withColumn("day", F.to_date("event_time"))


def public_events(events: DataFrame, organization: str) -> DataFrame:
    """What readers of one organization may see of an event: no payload, no provenance."""
    shown = ["event_id", "event_time", "event_type", "domain", "category", "action", "outcome", "user", "target", "group", "host_name", "source_ip", "source_port", "destination_ip", "destination_port", "transport", "protocol", "bytes", "packets", "name", "path", "status_code", "quality"]
    vendor = F.struct(F.col("vendor_name").alias("name"), F.col("vendor_product").alias("product"), F.col("vendor_dataset").alias("dataset")).alias("vendor")
    return events.where(F.col("error_code").isNull() & (F.col("organization_id") == organization)).select(*[c for c in shown if c in events.columns], vendor)


def public_other(rows: DataFrame, original: tuple[str, ...] = ("payload", "original")) -> DataFrame:
    """Rows of another data set (raw, quarantine) without the original text."""
    return rows.drop(*original)


def validate_auth_events(df: DataFrame, organization: str) -> DataFrame:
    """df(event_time, organization_id, event_id, kind, action, dataset, vendor_dataset, schema_version, outcome, quality, domain, category) with the code of the older authentication contract."""
    has = [text(F.col(c)).isNotNull() for c in ("event_id", "action", "dataset", "vendor_dataset", "schema_version")]
    fields = (F.col("kind") == "event") & (F.octet_length("event_id") <= 256) & has[0] & has[1] & has[2] & has[3] & has[4]
    code = first_failing(
        (F.col("event_time").isNotNull(), "EVENT_TIME_INVALID"), (F.col("organization_id") == organization, "TENANT_MISMATCH"), (fields, "REQUIRED_FIELD_MISSING"), (F.col("outcome").isin("success", "failure", "unknown"), "OUTCOME_INVALID"),
        (F.col("quality").isin("qualified", "partial", "invalid", "unsupported"), "QUALITY_INVALID"), (F.col("domain") == "authentication", "DOMAIN_UNSUPPORTED"), (F.array_contains("category", "authentication"), "CATEGORY_INVALID"),
    )
    return df.withColumn("error_code", code)
