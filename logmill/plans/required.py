"""What a match of a built-in pattern needs: one text of each tuple, and a line that begins with a character of a class.

They make cheap tests before the regex. A pattern without an entry (every pattern of a user) is just matched.
"""

# Fixed values, derived from the patterns of ``catalog``; tests hold them against matching texts.
REQUIRED: dict[str, tuple[str, ...]] = {
    r"^error\[E\d{4}\]:": ('error[E',),
    r"^\s+--> [^\n]+:\d+:\d+": ('--> ',),
    r"^(?:[^:\n]+/)*[^:\n]+\.rs:\d+:\d+: (?:error|warning)(?:\[E\d{4}\])?:": ('error', 'warning'),
    r"(?:error\[E\d{4}\]|warning:|error:)": ('error[E', 'warning:', 'error:'),
    r"^\[\]\nerror: no such object:": ('[]\nerror: no such object:',),
    r"(?:ERROR|error): failed to solve|failed to solve:": (': failed to solve', 'failed to solve:'),
    r"^.+\.c:\d+:\d+: error:": (': error:',),
    r"^.+\.(?:cc|cpp|cxx):\d+:\d+: error:": (': error:',),
    r"^fatal: not a git repository": ('fatal: not a git repository',),
    r"^.+\.java:\d+: error:": (': error:',),
    r'^Exception in thread \"': ('Exception in thread "',),
    r"^(?:TypeError|ReferenceError|SyntaxError|RangeError):": ('TypeError', 'ReferenceError', 'SyntaxError', 'RangeError'),
    r"^npm (?:ERR!|error)": ('npm ',),
    r"^psql: error:": ('psql: error:',),
    r"^Traceback \(most recent call last\):": ('Traceback (most recent call last):',),
    r"^(?:bash|sh|zsh): .*command not found": ('command not found',),
    r"^(?:Error|TypeError|ReferenceError|SyntaxError|RangeError):": ('Error', 'TypeError', 'ReferenceError', 'SyntaxError', 'RangeError'),
    r"^\s*at .*https?://": ('http',),
    r"^(?:Error|TypeError|ReferenceError|SyntaxError|InternalError|RangeError):": ('Error', 'TypeError', 'ReferenceError', 'SyntaxError', 'InternalError', 'RangeError'),
    r"^[^\n]*@https?://": ('@http',),
    r"@\[native code\]|^global code@": ('@[native code]', 'global code@'),
    r"Cross-Origin Request Blocked|blocked by CORS policy|Content Security Policy|Refused to (?:load|execute|connect)|Mixed Content:": ('Cross-Origin Request Blocked', 'blocked by CORS policy', 'Content Security Policy', 'Refused to ', 'Mixed Content:'),
    r"^\s*at ": ('at ',),
    r"\.min\.js:\d+:\d+|webpack://": ('.min.js:', 'webpack://'),
    r"The above error occurred in the <|Minified React error|Hydration failed": ('The above error occurred in the <', 'Minified React error', 'Hydration failed'),
    r"react|React|\.jsx?:\d+": ('react', 'React', '.js'),
    r"^\[Vue warn\]:|Unhandled error during execution of component": ('[Vue warn]:', 'Unhandled error during execution of component'),
    r"NG\d{4}:|NullInjectorError|R3InjectorError|Angular.*Error": ('NG', 'NullInjectorError', 'R3InjectorError', 'Angular'),
    r"^(?:Unhandled exception\. )?System\.[A-Za-z.]+Exception:": ('Exception:',),
    r"^\s*at [A-Za-z_][A-Za-z0-9_.+`<>]+": ('at ',),
    r"\.(?:cs|fs|vb|csproj|fsproj|vbproj)(?:\(\d+,\d+\)|:\d+:\d+): (?:error|warning) (?:CS|FS|BC|MSB|NU)\d+": ('error', 'warning'),
    r"^panic:": ('panic:',),
    r"^goroutine \d+ \[": ('goroutine ',),
    r"^--- FAIL:|^FAIL\s+\S+": ('--- FAIL:', 'FAIL'),
    r"^(?:LAST SEEN|FirstSeen\s+LastSeen).*(?:TYPE|Type).*(?:REASON|Reason)|Warning\s+(?:FailedScheduling|BackOff|FailedMount|Unhealthy)": ('LAST SEEN', 'FirstSeen', 'Warning'),
    r"^\[pod/[^/]+/container/[^]]+\]": ('/container/',),
    r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} \[(?:alert|crit|error|warn|notice|info)\]": ('alert', 'crit', 'error', 'warn', 'notice', 'info'),
    r"^\S+ \S+ \S+ \[[^]]+\] .(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) \S+ HTTP/": (' HTTP/',),
    r"^\d{4}-\d{2}-\d{2}T.*Z\s+\d+ \[(?:ERROR|Warning|Note)\] \[MY-\d+\]": ('] [MY-',),
    r"^[A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2} \S+ (?:systemd|\S+\.service)\[?": ('systemd', '.service'),
    r"^==\d+==ERROR: (?:AddressSanitizer|LeakSanitizer|ThreadSanitizer):": ('AddressSanitizer', 'LeakSanitizer', 'ThreadSanitizer'),
    r"Program received signal (?:SIGSEGV|SIGABRT|SIGBUS|SIGILL)": ('Program received signal SIG',),
    r"^#0\s+": ('#0',),
    r"Segmentation fault \(core dumped\)|segfault at .* ip .* error|Aborted \(core dumped\)": ('Segmentation fault (core dumped)', 'segfault at ', 'Aborted (core dumped)'),
    r"^\[[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} .*\] \[(?:error|warn|notice|info)\]": ('error', 'warn', 'notice', 'info'),
    r"^- \d+ \d{4}\.\d{2}\.\d{2} .* RAS ": (' RAS ',),
    r"^\d{4}-\d{2}-\d{2} .* (?:INFO|WARN|ERROR|FATAL) \[.*\] org\.apache\.hadoop": ('] org.apache.hadoop',),
    r"^\d{6} \d{6} \d+ (?:INFO|WARN|ERROR|FATAL) dfs\.": (' dfs.',),
    r"^\d+ node-\d+ node .* failure": (' failure',),
    r"sshd\(pam_unix\)|kernel:|su\(pam_unix\)": ('sshd(pam_unix)', 'kernel:', 'su(pam_unix)'),
    r"MacBook|corecaptured\[|secd\[|SpotlightNetHelper\[": ('MacBook', 'corecaptured[', 'secd[', 'SpotlightNetHelper['),
    r"^[A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2} \S+ sshd\[": (' sshd[',),
    r"Invalid user|Failed password|BREAK-IN ATTEMPT": ('Invalid user', 'Failed password', 'BREAK-IN ATTEMPT'),
    r"^nova-(?:api|compute)\.log.* \d{4}-\d{2}-\d{2} ": ('nova-',),
    r"^\[\d{2}\.\d{2} \d{2}:\d{2}:\d{2}\] .* error :": (' error :',),
    r"^\d{2}/\d{2}/\d{2} .* (?:INFO|WARN|ERROR) (?:spark|executor)\.": ('spark', 'executor'),
    r"^- \d+ \d{4}\.\d{2}\.\d{2} tbird-": (' tbird-',),
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}, (?:Info|Warning|Error)\s+CBS": ('Info', 'Warning', 'Error'),
    r"^\d{4}-\d{2}-\d{2} .* - (?:INFO|WARN|ERROR)\s+\[.*Quorum": ('Quorum',),
    r"^ts=\S+ caller=\S+ level=(?:debug|info|warn|error)": (' caller=',),
    r'\bmsg="': ('msg="',),
    r"^2 \d{12} eni-[0-9a-z]+ \S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+ (?:ACCEPT|REJECT|-) (?:OK|NODATA|SKIPDATA)$": (' eni-',),
    r"(?: ACCEPT OK| REJECT OK| - (?:NODATA|SKIPDATA))$": ('ACCEPT OK', 'REJECT OK', 'NODATA', 'SKIPDATA'),
    r"^\[[^]\n]+\] (?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL) .+ \((?:kafka\.|org\.apache\.kafka\.)": ('kafka.', 'org.apache.kafka.'),
    r"(?:Kafka|broker|ReplicaManager|GroupCoordinator|org\.apache\.kafka)": ('Kafka', 'broker', 'ReplicaManager', 'GroupCoordinator', 'org.apache.kafka'),
    r"^\[\d{4}-\d{2}-\d{2}T[^]\n]+\]\[(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL) ?\]\[[^]\n]+\] \[[^]\n]+\]": ('TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'),
    r"\[(?:o\.o\.|org\.opensearch\.)": ('.o.', 'rg.opensearch.'),
    r"^\d{4}-\d{2}-\d{2}[ T]\S+ \[(?:debug|info|warning|error|critical)\] <\d+\.\d+\.\d+>": ('debug', 'info', 'warning', 'error', 'critical'),
    r"(?:AMQP|RabbitMQ|rabbit@|vhost|channel|queue)": ('AMQP', 'RabbitMQ', 'rabbit@', 'vhost', 'channel', 'queue'),
    r'"event\.dataset":"elasticsearch\.(?:server|deprecation|audit)"': ('"event.dataset":"elasticsearch.',),
}

#: The first characters of the lines where a match may begin (an empty line's is its end).
STARTS: dict[str, str] = {
    r"^error\[E\d{4}\]:": r"[e]",
    r"^\s+--> [^\n]+:\d+:\d+": r"[\s]",
    r"^\[\]\nerror: no such object:": r"[\[]",
    r"^(?:#\d+|\s*=>).*": r"[\s#=]",
    r"^fatal: not a git repository": r"[f]",
    r'^Exception in thread \"': r"[E]",
    r"^(?:TypeError|ReferenceError|SyntaxError|RangeError):": r"[RST]",
    r"^npm (?:ERR!|error)": r"[n]",
    r"^psql: error:": r"[p]",
    r"^Traceback \(most recent call last\):": r"[T]",
    r"^(?:bash|sh|zsh): .*command not found": r"[bsz]",
    r"^(?:Error|TypeError|ReferenceError|SyntaxError|RangeError):": r"[ERST]",
    r"^\s*at .*https?://": r"[\sa]",
    r"^(?:Error|TypeError|ReferenceError|SyntaxError|InternalError|RangeError):": r"[EIRST]",
    r"^\s*at ": r"[\sa]",
    r"^(?:Unhandled exception\. )?System\.[A-Za-z.]+Exception:": r"[SU]",
    r"^\s*at [A-Za-z_][A-Za-z0-9_.+`<>]+": r"[\sa]",
    r"^panic:": r"[p]",
    r"^goroutine \d+ \[": r"[g]",
    r"^--- FAIL:|^FAIL\s+\S+": r"[\-F]",
    r"^\[pod/[^/]+/container/[^]]+\]": r"[\[]",
    r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2} \[(?:alert|crit|error|warn|notice|info)\]": r"[\d]",
    r"^\d{4}-\d{2}-\d{2}T.*Z\s+\d+ \[(?:ERROR|Warning|Note)\] \[MY-\d+\]": r"[\d]",
    r"^\d+:[MSC] \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}\.\d{3} [#*.-]": r"[\d]",
    r"^[A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2} \S+ (?:systemd|\S+\.service)\[?": r"[A-Z]",
    r"^==\d+==ERROR: (?:AddressSanitizer|LeakSanitizer|ThreadSanitizer):": r"[=]",
    r"^#0\s+": r"[#]",
    r"^\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}\s+\d+\s+\d+\s+[VDIWEF] ": r"[\d]",
    r"^\[[A-Z][a-z]{2} [A-Z][a-z]{2} \d{2} .*\] \[(?:error|warn|notice|info)\]": r"[\[]",
    r"^- \d+ \d{4}\.\d{2}\.\d{2} .* RAS ": r"[\-]",
    r"^\d{4}-\d{2}-\d{2} .* (?:INFO|WARN|ERROR|FATAL) \[.*\] org\.apache\.hadoop": r"[\d]",
    r"^\d{6} \d{6} \d+ (?:INFO|WARN|ERROR|FATAL) dfs\.": r"[\d]",
    r"^\d{8}-\d{2}:\d{2}:\d{2}:\d{3}\|": r"[\d]",
    r"^\d+ node-\d+ node .* failure": r"[\d]",
    r"^[A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2} \S+ ": r"[A-Z]",
    r"^[A-Z][a-z]{2}\s+\d+ \d{2}:\d{2}:\d{2} \S+ sshd\[": r"[A-Z]",
    r"^nova-(?:api|compute)\.log.* \d{4}-\d{2}-\d{2} ": r"[n]",
    r"^\[\d{2}\.\d{2} \d{2}:\d{2}:\d{2}\] .* error :": r"[\[]",
    r"^\d{2}/\d{2}/\d{2} .* (?:INFO|WARN|ERROR) (?:spark|executor)\.": r"[\d]",
    r"^- \d+ \d{4}\.\d{2}\.\d{2} tbird-": r"[\-]",
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}, (?:Info|Warning|Error)\s+CBS": r"[\d]",
    r"^\d{4}-\d{2}-\d{2} .* - (?:INFO|WARN|ERROR)\s+\[.*Quorum": r"[\d]",
    r"^ts=\S+ caller=\S+ level=(?:debug|info|warn|error)": r"[t]",
    r"^2 \d{12} eni-[0-9a-z]+ \S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+ \S+ (?:ACCEPT|REJECT|-) (?:OK|NODATA|SKIPDATA)$": r"[2]",
    r"^\[[^]\n]+\] (?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL) .+ \((?:kafka\.|org\.apache\.kafka\.)": r"[\[]",
    r"^\[\d{4}-\d{2}-\d{2}T[^]\n]+\]\[(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL) ?\]\[[^]\n]+\] \[[^]\n]+\]": r"[\[]",
    r"^\d{4}-\d{2}-\d{2}[ T]\S+ \[(?:debug|info|warning|error|critical)\] <\d+\.\d+\.\d+>": r"[\d]",
}
