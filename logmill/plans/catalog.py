"""The built-in log profiles and the profile data type.

A profile says how to recognise one log grammar (``all`` / ``any`` conditions) and how to cut a
document of that grammar into events (``parser``). Catalog order matters: on equal scores the
later profile wins.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

SCHEMA_VERSION = 3
FALLBACK = "raw"


@dataclass(frozen=True)
class Profile:
    id: str
    record_kind: str
    all: tuple = ()
    any: tuple = ()
    parser: dict = field(default_factory=dict)
    require_events: bool = True
    require_content: bool = True
    application: str | None = None
    catalog_rank: int | None = None

    @property
    def kind(self) -> str:
        return self.parser["kind"]

    @property
    def score(self) -> int:
        return 3 * len(self.all) + len(self.any)

    @property
    def label(self) -> str:
        return self.application or self.id

    def with_id(self, new_id: str) -> "Profile":
        return replace(self, id=new_id)

    def to_dict(self) -> dict:
        out = {
            "id": self.id,
            "record_kind": self.record_kind,
            "detect": {
                "all": [{"kind": k, "value": v} for k, v in self.all],
                "any": [{"kind": k, "value": v} for k, v in self.any],
            },
            "parser": self.parser,
            "validation": {
                "require_events": self.require_events,
                "require_content": self.require_content,
            },
        }
        if self.application is not None:
            out["application"] = self.application
        if self.catalog_rank is not None:
            out["catalog_rank"] = self.catalog_rank
        return out

    @classmethod
    def from_dict(cls, raw: dict) -> "Profile":
        def conditions(name):
            return tuple((c["kind"], c["value"]) for c in raw["detect"].get(name, []))

        checks = raw.get("validation", {})
        return cls(
            id=raw["id"],
            record_kind=raw["record_kind"],
            all=conditions("all"),
            any=conditions("any"),
            parser=dict(raw["parser"]),
            require_events=bool(checks.get("require_events", False)),
            require_content=bool(checks.get("require_content", False)),
            application=raw.get("application"),
            catalog_rank=raw.get("catalog_rank"),
        )


def parse_profiles(text: str) -> list[Profile]:
    """Profiles of one profile file (JSON text)."""
    return [Profile.from_dict(item) for item in json.loads(text)["formats"]]


def profiles_json(profiles: list[Profile]) -> str:
    return json.dumps(
        {
            "schema_version": SCHEMA_VERSION,
            "fallback": FALLBACK,
            "formats": [p.to_dict() for p in profiles],
        }
    )


def _rx(*patterns):
    return tuple(("regex", p) for p in patterns)


def _whole(id, severity, all, any=()):
    return Profile(id, "text", _rx(*all), _rx(*any), {"kind": "whole_text", "severity": severity})


def _lines(id, all, start, level="", any=(), application=None, rank=None, default="UNKNOWN"):
    parser = {
        "kind": "line_blocks",
        "start_regex": start,
        "severity_capture": level,
        "default_severity": default,
    }
    return Profile(id, "text", _rx(*all), _rx(*any), parser, application=application, catalog_rank=rank)


def _json(id, exists, fields, fingerprint, *, suffix, time, level, default="UNKNOWN", status=(),
          nonzero_is_error=False, status_from_text=False, digits=True, regex=(), application=None,
          rank=None):
    parser = {
        "kind": "json_fields",
        "source_suffix": suffix,
        "timestamp_paths": list(time),
        "severity_paths": list(level),
        "default_severity": default,
        "status_paths": list(status),
        "nonzero_status_is_error": nonzero_is_error,
        "status_from_text": status_from_text,
        "fields": [{"label": label, "paths": list(paths)} for label, *paths in fields],
        "fingerprint_paths": list(fingerprint),
        "normalize_fingerprint_digits": digits,
    }
    detect = tuple(("path_exists", p) for p in exists) + _rx(*regex)
    return Profile(id, "json", detect, (), parser, application=application, catalog_rank=rank)


# --- Fixed values: ids, detection patterns, block starts, severities and JSON paths below must
# --- equal the documented log grammars for results to agree. Patterns use the (?P<name>...) form.
JS_ERROR = r"^(?:Error|TypeError|ReferenceError|SyntaxError|RangeError):"
SYSLOG_HOST = r"^[A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2} \S+ "
SYSLOG_TIME = r"^[A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2} "

FLOW_FIELDS = [
    "version", "account-id", "interface-id", "srcaddr", "dstaddr", "srcport", "dstport",
    "protocol", "packets", "bytes", "start", "end", "action", "log-status",
]

BUILT_IN: tuple[Profile, ...] = (
    Profile(
        "cargo-rustc-error", "text",
        _rx(r"^error\[E\d{4}\]:", r"^\s+--> [^\n]+:\d+:\d+"), (),
        {"kind": "text_blocks", "start_regex": r"^error(?:\[E\d{4}\])?:", "severity": "ERROR",
         "preamble_severity": "INFO", "include_preamble": True},
    ),
    _lines(
        "rustc-clippy-short-diagnostic",
        [r"^(?:[^:\n]+/)*[^:\n]+\.rs:\d+:\d+: (?:error|warning)(?:\[E\d{4}\])?:",
         r"(?:error\[E\d{4}\]|warning:|error:)"],
        r"^(?:[^:\n]+/)*[^:\n]+\.rs:\d+:\d+: (?P<level>error|warning)(?:\[E\d{4}\])?:",
        "level", application="rustc and Clippy short diagnostics", default="ERROR",
    ),
    _whole("docker-cli-error", "ERROR", [r"^\[\]\nerror: no such object:"]),
    Profile(
        "docker-buildkit-error", "text",
        _rx(r"^(?:#\d+|\s*=>).*", r"(?:ERROR|error): failed to solve|failed to solve:"), (),
        {"kind": "buildkit"},
    ),
    _whole("gcc-compiler", "ERROR", [r"^.+\.c:\d+:\d+: error:"]),
    _whole("gpp-compiler", "ERROR", [r"^.+\.(?:cc|cpp|cxx):\d+:\d+: error:"]),
    _whole("git-cli-error", "FATAL", [r"^fatal: not a git repository"]),
    _whole("javac-compiler", "ERROR", [r"^.+\.java:\d+: error:"]),
    _whole("java-exception", "ERROR", [r'^Exception in thread \"']),
    _whole("node-exception", "ERROR", [r"^(?:TypeError|ReferenceError|SyntaxError|RangeError):"]),
    _whole("npm-cli-error", "ERROR", [r"^npm (?:ERR!|error)"]),
    _whole("postgres-client-error", "ERROR", [r"^psql: error:"]),
    _whole("python-traceback", "ERROR", [r"^Traceback \(most recent call last\):"]),
    _whole("shell-command-not-found", "ERROR", [r"^(?:bash|sh|zsh): .*command not found"]),
    _whole("browser-chromium-v8-stack", "ERROR", [JS_ERROR, r"^\s*at .*https?://"]),
    _whole(
        "browser-firefox-stack", "ERROR",
        [r"^(?:Error|TypeError|ReferenceError|SyntaxError|InternalError|RangeError):",
         r"^[^\n]*@https?://"],
    ),
    _whole("browser-safari-webkit-stack", "ERROR", [JS_ERROR, r"^[^\n]*@https?://"],
           [r"@\[native code\]|^global code@"]),
    _whole(
        "browser-console-security", "ERROR",
        [r"Cross-Origin Request Blocked|blocked by CORS policy|Content Security Policy"
         r"|Refused to (?:load|execute|connect)|Mixed Content:"],
    ),
    _whole("browser-minified-v8-stack", "ERROR",
           [JS_ERROR, r"^\s*at ", r"\.min\.js:\d+:\d+|webpack://"]),
    _whole("react-browser-error", "ERROR",
           [r"The above error occurred in the <|Minified React error|Hydration failed"],
           [r"react|React|\.jsx?:\d+"]),
    _whole("vue-browser-error", "ERROR",
           [r"^\[Vue warn\]:|Unhandled error during execution of component"]),
    _whole("angular-browser-error", "ERROR",
           [r"NG\d{4}:|NullInjectorError|R3InjectorError|Angular.*Error"]),
    _whole("dotnet-exception", "ERROR",
           [r"^(?:Unhandled exception\. )?System\.[A-Za-z.]+Exception:",
            r"^\s*at [A-Za-z_][A-Za-z0-9_.+`<>]+"]),
    _whole("msbuild-diagnostic", "ERROR",
           [r"\.(?:cs|fs|vb|csproj|fsproj|vbproj)(?:\(\d+,\d+\)|:\d+:\d+): (?:error|warning)"
            r" (?:CS|FS|BC|MSB|NU)\d+"]),
    _whole("go-panic", "PANIC", [r"^panic:", r"^goroutine \d+ \["]),
    _whole("go-test-failure", "ERROR", [r"^--- FAIL:|^FAIL\s+\S+"]),
    _whole(
        "kubernetes-events", "WARNING",
        [r"^(?:LAST SEEN|FirstSeen\s+LastSeen).*(?:TYPE|Type).*(?:REASON|Reason)"
         r"|Warning\s+(?:FailedScheduling|BackOff|FailedMount|Unhealthy)"],
    ),
    _lines("kubernetes-prefixed-pod-log", [r"^\[pod/[^/]+/container/[^]]+\]"],
           r"^\[pod/[^/]+/container/[^]]+\]"),
    _lines(
        "nginx-error",
        [r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} \[(?:alert|crit|error|warn|notice|info)\]"],
        r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} \[(?P<level>alert|crit|error|warn|notice|info)\]",
        "level",
    ),
    _lines(
        "nginx-access",
        [r"^\S+ \S+ \S+ \[[^]]+\] .(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) \S+ HTTP/"],
        r"^\S+ \S+ \S+ \[[^]]+\] ",
    ),
    _lines(
        "mysql-error-log",
        [r"^\d{4}-\d{2}-\d{2}T.*Z\s+\d+ \[(?:ERROR|Warning|Note)\] \[MY-\d+\]"],
        r"^\d{4}-\d{2}-\d{2}T.*Z\s+\d+ \[(?P<level>ERROR|Warning|Note)\]",
        "level",
    ),
    _lines(
        "redis-log",
        [r"^\d+:[MSC] \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}\.\d{3} [#*.-]"],
        r"^\d+:[MSC] \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}\.\d{3} ",
    ),
    _json(
        "mongodb-json-log", ["$.t", "$.s", "$.msg"],
        [("", "$.c"), ("", "$.msg"), ("attr", "$.attr")],
        ["$.s", "$.c", "$.id", "$.msg"],
        suffix=" / MongoDB", time=["$.t.$date", "$.t"], level=["$.s"],
    ),
    _lines("systemd-journal-short",
           [r"^[A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2} \S+ (?:systemd|\S+\.service)\[?"], SYSLOG_TIME),
    _json(
        "systemd-journal-json", ["$.__REALTIME_TIMESTAMP", "$.PRIORITY", "$.MESSAGE"],
        [("unit", "$._SYSTEMD_UNIT", "$.SYSLOG_IDENTIFIER"), ("", "$.MESSAGE")],
        ["$.PRIORITY", "$._SYSTEMD_UNIT", "$.SYSLOG_IDENTIFIER", "$.MESSAGE"],
        suffix=" / journal", time=["$.__REALTIME_TIMESTAMP", "$.SYSLOG_TIMESTAMP"],
        level=["$.PRIORITY"],
    ),
    _whole("native-asan", "CRITICAL",
           [r"^==\d+==ERROR: (?:AddressSanitizer|LeakSanitizer|ThreadSanitizer):"]),
    _whole("native-gdb-backtrace", "CRITICAL",
           [r"Program received signal (?:SIGSEGV|SIGABRT|SIGBUS|SIGILL)", r"^#0\s+"]),
    _whole("native-crash", "CRITICAL",
           [r"Segmentation fault \(core dumped\)|segfault at .* ip .* error|Aborted \(core dumped\)"]),
    _lines(
        "android-logcat",
        [r"^\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}\s+\d+\s+\d+\s+[VDIWEF] "],
        r"^\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}\s+\d+\s+\d+\s+(?P<level>[VDIWEF]) ",
        "level",
    ),
    _lines("apache-error-log",
           [r"^\[[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} .*\] \[(?:error|warn|notice|info)\]"],
           r"^\[[^]]+\] \[(?P<level>error|warn|notice|info)\]", "level"),
    _lines("bgl-ras", [r"^- \d+ \d{4}\.\d{2}\.\d{2} .* RAS "],
           r"^(?:- |APPREAD )\d+ .* RAS \S+ (?P<level>INFO|WARN|ERROR|FATAL) ", "level"),
    _lines("hadoop",
           [r"^\d{4}-\d{2}-\d{2} .* (?:INFO|WARN|ERROR|FATAL) \[.*\] org\.apache\.hadoop"],
           r"^\d{4}-\d{2}-\d{2} .* (?P<level>INFO|WARN|ERROR|FATAL) \[", "level"),
    _lines("hdfs", [r"^\d{6} \d{6} \d+ (?:INFO|WARN|ERROR|FATAL) dfs\."],
           r"^\d{6} \d{6} \d+ (?P<level>INFO|WARN|ERROR|FATAL) ", "level"),
    _lines("healthapp", [r"^\d{8}-\d{2}:\d{2}:\d{2}:\d{3}\|"],
           r"^\d{8}-\d{1,2}:\d{2}:\d{2}:\d{3}\|"),
    _lines("hpc-failure", [r"^\d+ node-\d+ node .* failure"], r"^\d+ \S+ \S+ "),
    _lines("linux-syslog", [SYSLOG_HOST], SYSLOG_TIME,
           any=[r"sshd\(pam_unix\)|kernel:|su\(pam_unix\)"]),
    _lines("mac-unified-syslog", [SYSLOG_HOST], SYSLOG_TIME,
           any=[r"MacBook|corecaptured\[|secd\[|SpotlightNetHelper\["]),
    _lines("openssh-auth", [r"^[A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2} \S+ sshd\["], SYSLOG_TIME,
           any=[r"Invalid user|Failed password|BREAK-IN ATTEMPT"]),
    _lines("openstack", [r"^nova-(?:api|compute)\.log.* \d{4}-\d{2}-\d{2} "],
           r"^nova-.*? \d{4}-\d{2}-\d{2} .*? (?P<level>INFO|WARNING|ERROR|CRITICAL) ", "level"),
    _lines("proxifier", [r"^\[\d{2}\.\d{2} \d{2}:\d{2}:\d{2}\] .* error :"],
           r"^\[\d{2}\.\d{2} \d{2}:\d{2}:\d{2}\] "),
    _lines("spark", [r"^\d{2}/\d{2}/\d{2} .* (?:INFO|WARN|ERROR) (?:spark|executor)\."],
           r"^\d{2}/\d{2}/\d{2} .* (?P<level>INFO|WARN|ERROR) ", "level"),
    _lines("thunderbird-ras", [r"^- \d+ \d{4}\.\d{2}\.\d{2} tbird-"],
           r"^- \d+ \d{4}\.\d{2}\.\d{2} "),
    _lines("windows-cbs",
           [r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}, (?:Info|Warning|Error)\s+CBS"],
           r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}, (?P<level>Info|Warning|Error)\s+", "level"),
    _lines("zookeeper", [r"^\d{4}-\d{2}-\d{2} .* - (?:INFO|WARN|ERROR)\s+\[.*Quorum"],
           r"^\d{4}-\d{2}-\d{2} .* - (?P<level>INFO|WARN|ERROR)\s+", "level"),
    _lines(
        "prometheus-logfmt",
        [r"^ts=\S+ caller=\S+ level=(?:debug|info|warn|error)", r'\bmsg="'],
        r"^ts=\S+ caller=\S+ level=(?P<level>debug|info|warn|error)", "level",
        application="Prometheus and Alertmanager logfmt", rank=40,
    ),
    Profile(
        "aws-vpc-flow-default", "text",
        _rx(r"^2 \d{12} eni-[0-9a-z]+ \S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+"
            r" (?:ACCEPT|REJECT|-) (?:OK|NODATA|SKIPDATA)$",
            r"(?: ACCEPT OK| REJECT OK| - (?:NODATA|SKIPDATA))$"), (),
        {"kind": "delimited_lines", "delimiter": "whitespace", "fields": FLOW_FIELDS,
         "severity_rules": [
             {"field": "action", "values": ["REJECT"], "severity": "ERROR"},
             {"field": "log-status", "values": ["SKIPDATA"], "severity": "WARNING"},
         ],
         "default_severity": "INFO"},
        application="AWS VPC Flow Logs default format", catalog_rank=3,
    ),
    _lines(
        "kafka-broker-log4j",
        [r"^\[[^]\n]+\] (?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL) .+ \((?:kafka\.|org\.apache\.kafka\.)",
         r"(?:Kafka|broker|ReplicaManager|GroupCoordinator|org\.apache\.kafka)"],
        r"^\[[^]\n]+\] (?P<level>TRACE|DEBUG|INFO|WARN|ERROR|FATAL) .+"
        r" \((?:kafka\.|org\.apache\.kafka\.)",
        "level", application="Apache Kafka broker Log4j2", rank=2,
    ),
    _lines(
        "opensearch-application-log",
        [r"^\[\d{4}-\d{2}-\d{2}T[^]\n]+\]\[(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL) ?\]"
         r"\[[^]\n]+\] \[[^]\n]+\]",
         r"\[(?:o\.o\.|org\.opensearch\.)"],
        r"^\[\d{4}-\d{2}-\d{2}T[^]\n]+\]\[(?P<level>TRACE|DEBUG|INFO|WARN|ERROR|FATAL) ?\]"
        r"\[[^]\n]+\] \[[^]\n]+\]",
        "level", application="OpenSearch application logs", rank=9,
    ),
    _lines(
        "rabbitmq-plaintext",
        [r"^\d{4}-\d{2}-\d{2}[ T]\S+ \[(?:debug|info|warning|error|critical)\] <\d+\.\d+\.\d+>",
         r"(?:AMQP|RabbitMQ|rabbit@|vhost|channel|queue)"],
        r"^\d{4}-\d{2}-\d{2}[ T]\S+ \[(?P<level>debug|info|warning|error|critical)\] <\d+\.\d+\.\d+>",
        "level", application="RabbitMQ", rank=35,
    ),
    _json(
        "elastic-ecs-server-json", ["$.event.dataset"],
        [("", "$.message"), ("dataset", "$.event.dataset"), ("error", "$.error.message"),
         ("stack", "$.error.stack_trace")],
        ["$.log.level", "$.message", "$.error.type", "$.error.message"],
        suffix=" / Elastic ECS", time=["$.@timestamp"], level=["$.log.level"],
        regex=[r'"event\.dataset":"elasticsearch\.(?:server|deprecation|audit)"'],
        application="Elasticsearch ECS server logs", rank=8,
    ),
    _json(
        "gcp-http-request", ["$.insertId", "$.httpRequest"],
        [("", "$.httpRequest.requestMethod"), ("", "$.httpRequest.requestUrl"),
         ("status", "$.httpRequest.status"), ("latency", "$.httpRequest.latency"),
         ("", "$.textPayload", "$.jsonPayload.message")],
        ["$.severity", "$.httpRequest.requestMethod", "$.httpRequest.requestUrl",
         "$.httpRequest.status", "$.textPayload", "$.jsonPayload.message"],
        suffix="", time=["$.timestamp", "$.receiveTimestamp"], level=["$.severity"],
        status=["$.httpRequest.status"], digits=False,
    ),
    _json(
        "gcp-proto-payload-audit", ["$.insertId", "$.protoPayload"],
        [("", "$.protoPayload.serviceName"), ("", "$.protoPayload.methodName"),
         ("", "$.protoPayload.resourceName"), ("status", "$.protoPayload.status.message")],
        ["$.severity", "$.protoPayload.serviceName", "$.protoPayload.methodName",
         "$.protoPayload.resourceName", "$.protoPayload.status.code"],
        suffix=" / protoPayload", time=["$.timestamp", "$.receiveTimestamp"],
        level=["$.severity"], default="INFO", status=["$.protoPayload.status.code"],
        nonzero_is_error=True, digits=False,
    ),
    _json(
        "gcp-text-payload", ["$.insertId", "$.textPayload"], [("", "$.textPayload")],
        ["$.textPayload"],
        suffix=" / textPayload", time=["$.timestamp", "$.receiveTimestamp"],
        level=["$.severity"], status_from_text=True,
    ),
    _json(
        "gcp-json-payload", ["$.insertId", "$.jsonPayload"],
        [("", "$.jsonPayload.message", "$.jsonPayload.msg", "$.jsonPayload")],
        ["$.severity", "$.jsonPayload.code", "$.jsonPayload.message", "$.jsonPayload.msg"],
        suffix=" / jsonPayload", time=["$.timestamp", "$.receiveTimestamp"],
        level=["$.severity", "$.jsonPayload.severity", "$.jsonPayload.level"],
        status=["$.jsonPayload.status", "$.jsonPayload.statusCode"],
    ),
)
