"""A document for every event, in the grammar of each built-in profile in turn.

Styles take turns by event id; ``{n}`` is the event and ``{u}`` its owner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logmill.plans.synth import spread

CBS, FLOW = "2026-02-16 11:12:1", "2 123456789012 eni-a{u} 10.0.0.1 10.0.0.2 1 2 6 3 4 5 6 "
BGL = " 2026.02.02 N07 2026-02-02 N07 RAS KERNEL "
# Sample grammar of every profile.
TEXTS = {
    "cargo-rustc-error": "   Compiling demo{n}\nerror[E0425]: no value `x{u}`\n  --> src/main.rs:2:5\n   |\nerror[E0308]: mismatched {n}\n  --> src/lib.rs:1:1",
    "rustc-clippy-short-diagnostic": "src/lib{n}.rs:10:4: warning: unused\nsrc/lib.rs:11:1: error[E0308]: mismatched\n  note {u}",
    "docker-cli-error": "[]\nerror: no such object: web{n}",
    "docker-buildkit-error": "#1 load\n#2 RUN make {n}\n#2 ERROR: exit code: 2\nERROR: failed to solve: x{u}",
    "gcc-compiler": "main{n}.c:3:9: error: expected ';'",
    "gpp-compiler": "main{n}.cpp:3:9: error: expected ';'",
    "git-cli-error": "fatal: not a git repository: .git{n}",
    "javac-compiler": "Main{n}.java:7: error: ';' expected",
    "java-exception": 'Exception in thread "main" java.lang.IllegalStateException: {n}\n\tat Main.run(Main.java:3)',
    "node-exception": "ReferenceError: y{n} is not defined\n    at file.js:1:1",
    "npm-cli-error": "npm ERR! code E{n}\nnpm ERR! path {u}",
    "postgres-client-error": "psql: error: connection {n} refused",
    "python-traceback": 'Traceback (most recent call last):\n  File "a.py", line {n}\nKeyError: {u}',
    "shell-command-not-found": "bash: foo{n}: command not found",
    "browser-chromium-v8-stack": "TypeError: x{n} is undefined\n    at f (https://a.example/app.js:{u}:2)",
    "browser-firefox-stack": "InternalError: too much recursion {n}\nf@https://a.example/app.js:1:2",
    "browser-safari-webkit-stack": "TypeError: undefined {n}\nf@https://a.example/app.js:1:2\nglobal code@https://a.example/b.js",
    "browser-console-security": "Refused to load the script {n} because of a rule",
    "browser-minified-v8-stack": "Error: boom {n}\n    at a (https://a.example/x.min.js:1:{u})",
    "react-browser-error": "Minified React error #{n}; visit the site",
    "vue-browser-error": "[Vue warn]: bad prop {n}",
    "angular-browser-error": "ERROR NG0100: changed {n}",
    "dotnet-exception": "System.ArgumentException: bad {n}\n   at App.Run() in /a.cs:line {u}",
    "msbuild-diagnostic": "A{n}.cs(1,2): error CS1002: ; expected",
    "go-panic": "panic: boom {n}\n\ngoroutine 7 [running]:\nmain.main()",
    "go-test-failure": "--- FAIL: Test{n} (0.00s)\n    x_test.go:1: no",
    "kubernetes-events": "1s Warning FailedMount pod/a{n} no volume",
    "kubernetes-prefixed-pod-log": "[pod/a-{n}/container/c] started\n[pod/a-{n}/container/c] ERROR down\n  more",
    "nginx-error": "2026/01/02 03:04:05 [crit] 1#1: *{n} timeout\n2026/01/02 03:04:06 [notice] 1#1: signal {u}",
    "nginx-access": '10.1.1.1 - - [01/Jan/2026:00:00:00 +0000] "GET /a{n} HTTP/1.1" 503 10\n10.1.1.1 - - [01/Jan/2026:00:00:01 +0000] "GET /b HTTP/1.1" 200 10',
    "mysql-error-log": "2026-01-02T03:04:05.1Z 0 [Warning] [MY-010001] [Server] slow {n}\n2026-01-02T03:04:05.2Z 0 [Note] [MY-010002] [Server] ready",
    "redis-log": "12:M 01 Jan 2026 00:00:00.123 * Ready {n}\n12:M 01 Jan 2026 00:00:00.124 # Failed opening {u}",
    "mongodb-json-log": '{"t":{"$date":"2026"},"s":"W","c":"NET","id":{n},"msg":"slow {u}","attr":{"b":1,"a":2}}\n{"t":{"$date":"2026"},"s":"F","c":"NET","id":{n},"msg":"down"}',
    "systemd-journal-short": "Jan  2 03:04:05 host systemd[1]: Started x{n}\nJan  2 03:04:06 host systemd[1]: x{u}.service failed",
    "systemd-journal-json": '{"__REALTIME_TIMESTAMP":"{n}","PRIORITY":"2","MESSAGE":"down","_SYSTEMD_UNIT":"a{u}.service"}',
    "native-asan": "=={n}==ERROR: AddressSanitizer: use-after-free",
    "native-gdb-backtrace": "Program received signal SIGABRT, Aborted {n}.\n#0  raise ()",
    "native-crash": "Segmentation fault (core dumped) {n}",
    "android-logcat": "02-09 07:08:09.101  4021  4077 W Tag: low memory {n}\n  more\n02-09 07:08:09.102  4021  4077 I Tag: fine",
    "apache-error-log": "[Tue Feb 10 08:15:34 2026] [notice] child {n} started\n[Tue Feb 10 08:15:35 2026] [error] down",
    "bgl-ras": f"- 1770000000{BGL}FATAL parity {{n}}\n- 1770000001{BGL}INFO ok",
    "hadoop": "2026-01-02 03:04:05,1 WARN [main] org.apache.hadoop.mapreduce: slow {n}\n\tat x\n2026-01-02 03:04:06,1 FATAL [main] org.apache.hadoop.y: end",
    "hdfs": "260207 101112 77 INFO dfs.DataNode: served {n}\n260207 101113 77 ERROR dfs.DataNode: lost",
    "healthapp": "20260211-06:07:08:909|Walk|{n}|update\n20260211-06:07:08:910|Walk|{n}|warned",
    "hpc-failure": "31 node-4 node state {n} failure here\n32 node-5 node up",
    "linux-syslog": "Feb 11 12:13:11 alder kernel: device {n} up\nFeb 11 12:13:12 alder kernel: panic now",
    "mac-unified-syslog": "Feb  3 05:06:07 MacBook-Lab app[1]: hello {n}",
    "openssh-auth": "Feb 12 13:14:16 host sshd[1]: Invalid user bob{n}\nFeb 12 13:14:17 host sshd[1]: Failed password for x",
    "openstack": "nova-api.log.1 2026-02-13 04:05:06.708 311 INFO nova.osapi req {n} done\nnova-api.log.1 2026-02-13 04:05:06.709 311 WARNING nova.osapi slow",
    "proxifier": "[02.14 09:10:16] a.exe - host:80 error : no route {n}\n[02.14 09:10:17] a.exe - host:80 open",
    "spark": "26/02/15 10:11:10 WARN executor.Executor: lost {n}\n26/02/15 10:11:11 INFO executor.Executor: ok",
    "thunderbird-ras": "- 1771100000 2026.02.14 tbird-8 Feb 14 x: session {n} opened",
    "windows-cbs": f"{CBS}0, Warning               CBS    odd {{n}}\n{CBS}1, Info                  CBS    ok",
    "zookeeper": "2026-02-17 12:13:14,747 - WARN  [Quorum:1] - broken {n}\n2026-02-17 12:13:15,747 - INFO  [Quorum:1] - ok",
    "prometheus-logfmt": 'ts=2026 caller=main.go:1 level=error msg="bad {n}"\nts=2027 caller=main.go:1 level=debug msg="x"',
    "aws-vpc-flow-default": f"{FLOW}REJECT OK\nshort line\n{FLOW}- SKIPDATA\n{FLOW}ACCEPT OK",
    "kafka-broker-log4j": "[2026-01-01] ERROR [Broker id={n}] x (kafka.server.KafkaApis)\n\tat y\n[2026-01-01] INFO [Broker id=1] y (kafka.server.X)",
    "opensearch-application-log": "[2026-01-01T00:00:00,1][WARN ][o.o.n.Node] [n1] message {n} [o.o.x]",
    "rabbitmq-plaintext": "2026-01-01 00:00:00.1 [error] <0.1.0> closing AMQP connection {n}\n2026-01-01 00:00:00.2 [info] <0.1.0> up",
    "elastic-ecs-server-json": '{"@timestamp":"t","log.level":"WARN","event.dataset":"elasticsearch.server","message":"m {n}"}',
    "gcp-http-request": '{"insertId":"{n}","httpRequest":{"requestMethod":"GET","requestUrl":"/x{u}","status":502}}',
    "gcp-proto-payload-audit": '{"insertId":"{n}","protoPayload":{"serviceName":"s","methodName":"m","status":{"code":7}}}',
    "gcp-text-payload": '{"insertId":"{n}","textPayload":"GET / 404 done"}',
    "gcp-json-payload": '{"insertId":"{n}","jsonPayload":{"message":"all fine"},"severity":"NOTICE"}',
}


def profile_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, name and text: one document for every event."""
    texts = F.array(*map(F.lit, TEXTS.values()))
    text = F.get(texts, (F.col("event_id") % len(TEXTS)).cast("int"))
    for mark, column in (("{n}", "event_id"), ("{u}", "user_id")):
        text = F.replace(text, F.lit(mark), F.col(column).cast("string"))
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")).select(
        F.col("event_id").alias("doc_id"), F.concat(F.lit("log-"), "event_id", F.lit(".log")).alias("name"), text.alias("text")
    )
