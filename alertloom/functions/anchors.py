"""Anchor fields: the fields of an alert that conditions may name, their roles, the host they belong to, and how each value may be used."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.functions import addresses, context
from alertloom.functions import scalars as fn
from alertloom.functions.globs import any_glob

# Anchor fields of each shape of document with their roles.
AGENT_FIELDS = {
    "agent.name": "host",
    "predecoder.hostname": "host",
    "location": "source",
    "decoder.name": "source",
    "data.win.system.providerName": "source",
    "data.srcip": "src_ip",
    "data.dstip": "peer_ip",
    "data.src_ip": "peer_ip",
    "data.dest_ip": "peer_ip",
    "data.win.eventdata.ipAddress": "peer_ip",
    "data.win.eventdata.sourceIp": "peer_ip",
    "data.win.eventdata.destinationIp": "peer_ip",
    "data.srcuser": "user",
    "data.dstuser": "user",
    "data.win.eventdata.subjectUserName": "user",
    "data.win.eventdata.targetUserName": "user",
    "data.win.eventdata.image": "process",
    "data.win.eventdata.parentImage": "process",
    "data.win.eventdata.newProcessName": "process",
    "data.win.eventdata.parentProcessName": "process",
    "syscheck.path": "file",
    "data.win.eventdata.commandLine": "attacker",
    "data.win.eventdata.parentCommandLine": "attacker",
    "data.url": "attacker",
    "data.win.eventdata.targetFilename": "attacker",
    "data.win.eventdata.queryName": "attacker",
}
ECS_FIELDS = {
    "host.name": "host",
    "agent.name": "host",
    "event.dataset": "source",
    "source.ip": "src_ip",
    "destination.ip": "peer_ip",
    "user.name": "user",
    "process.executable": "process",
    "process.parent.executable": "process",
    "file.path": "file",
    "process.command_line": "attacker",
    "url.original": "attacker",
    "url.full": "attacker",
    "user_agent.original": "attacker",
    "file.name": "attacker",
    "dns.question.name": "attacker",
}
FIELDS = {"wazuh4": AGENT_FIELDS, "ecs": ECS_FIELDS, "wazuh5": ECS_FIELDS}
# Where each shape names the host, first one first.
HOST_PATHS = {"wazuh4": ("agent.name", "predecoder.hostname"), "ecs": ("host.name", "agent.name"), "wazuh5": ("host.name", "agent.name")}
# Source addresses among the IP fields, users that an attacker chooses in failed logons, fields pinned with another, and
# paths of files that a rule on file changes may name alone.
SOURCES = ("data.srcip", "data.src_ip", "data.win.eventdata.ipAddress", "data.win.eventdata.sourceIp", "source.ip")
FAILURE_SENSITIVE = ("data.srcuser", "data.dstuser", "data.win.eventdata.targetUserName", "user.name")
COMPANIONS = {"data.win.eventdata.targetUserName": "data.win.eventdata.logonType"}
CHANGED_FILES = ("syscheck.path", "file.path")
# Places that are the same for every event of their kind.
STATIC_PLACES = ("EventChannel", "WinEvtLog", "syscheck", "rootcheck", "sca", "syscollector", "vulnerability-detector", "osquery", "aws-s3", "ciscat", "wazuh-modulesd", "journald", "macos")
# Names of service accounts, and of interpreters and parents that anything may run under.
SERVICE_ACCOUNTS = ("svc_*", "svc-*", "svc.*", "service_*", "sa_*", "*_svc")
GENERIC_PROCESSES = (
    "powershell.exe", "powershell_ise.exe", "pwsh.exe", "pwsh", "cmd.exe", "command.com", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "certutil.exe", "bitsadmin.exe",
    "msiexec.exe", "msbuild.exe", "installutil.exe", "regasm.exe", "regsvcs.exe", "cmstp.exe", "odbcconf.exe", "mavinject.exe", "msdt.exe", "hh.exe", "forfiles.exe", "pcalua.exe", "control.exe",
    "wmic.exe", "wmiprvse.exe", "wsmprovhost.exe", "winrshost.exe", "schtasks.exe", "at.exe", "sc.exe", "net.exe", "net1.exe", "reg.exe", "curl.exe", "wget.exe", "ftp.exe", "bash.exe", "wsl.exe",
    "svchost.exe", "services.exe", "explorer.exe", "taskeng.exe", "taskhost.exe", "taskhostw.exe", "dllhost.exe", "conhost.exe", "runtimebroker.exe", "userinit.exe", "winlogon.exe", "mmc.exe",
    "python*", "py.exe", "pyw.exe", "perl*", "ruby*", "php*", "node", "node.exe", "java", "java.exe", "javaw.exe", "osascript", "sh", "bash", "dash", "zsh", "ksh", "csh", "tcsh", "fish", "busybox",
    "env", "sudo", "su", "nohup", "xargs", "cron", "crond", "systemd", "init", "sshd", "curl", "wget", "nc", "ncat", "netcat", "socat", "awk", "gawk", "openssl",
)
# Names under which a list of trusted entities may give a role.
TRUST_NAMES = {"host": "host", "src_ip": "src_ip", "user": "user", "process": "process"}
#: Longer values are no conditions; a field that is a list gives so many values.
LONGEST, VALUES = 1024, 8
MANAGER = "000"
VALUE = "struct<path:string,role:string,value:string>"


def _table(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def usable(values: Column) -> Column:
    """The values of a field that can be conditions, distinct, in order."""
    fine = F.filter(values, lambda v: fn.absent(v).isNotNull() & (F.length(v) <= LONGEST))
    return F.slice(F.array_distinct(fine), 1, VALUES)


def sender(place: Column) -> Column:
    """Whether a place names the device that sent the log: an address, or a host before an arrow."""
    return F.coalesce(place.contains("->") | addresses.address(place).isNotNull(), F.lit(False))


def host(fields: Column, profile: str) -> Column:
    """Struct (path, value) of the device that an alert is about, or null. The manager's own name is none: for what it relays, the
    header's host name counts, else the sender's address."""
    first = lambda p: F.get(usable(F.element_at(fields, p)), F.lit(0))
    named = lambda p, v: F.when(v.isNotNull(), F.struct(F.lit(p).alias("path"), v.alias("value")))
    own = F.coalesce(*[named(p, first(p)) for p in HOST_PATHS[profile]])
    if profile != "wazuh4":
        return own
    places = usable(F.element_at(fields, "location"))
    relayed = F.coalesce(named("predecoder.hostname", first("predecoder.hostname")), F.when((F.size(places) == 1) & sender(F.get(places, F.lit(0))), named("location", F.get(places, F.lit(0)))))
    return F.when(F.coalesce(first("agent.id") == MANAGER, F.lit(False)), relayed).otherwise(own)


def values(fields: Column, at: Column, profile: str) -> Column:
    """Array of (path, role, value) of all anchor fields of an alert with the host ``at``; no field is named here, all come from the table.

    Other spellings of the host under another path add nothing, nor does the manager's name of what it relays, nor a static place.
    """
    roles = _table(FIELDS[profile])
    manager = F.coalesce(F.get(F.element_at(fields, "agent.id"), F.lit(0)) == MANAGER, F.lit(False)) if profile == "wazuh4" else F.lit(False)
    known = F.filter(F.map_entries(fields), lambda e: F.map_contains_key(roles, e["key"]))
    each = F.flatten(F.transform(known, lambda e: F.transform(usable(e["value"]), lambda v: F.struct(e["key"].alias("path"), F.element_at(roles, e["key"]).alias("role"), v.alias("value")))))
    is_host = lambda x: F.coalesce(x["path"] == at["path"], F.lit(False))
    fits = F.filter(
        each,
        lambda x: F.when(x["role"] == "host", F.when(is_host(x), x["value"] == at["value"]).otherwise(~(manager & (x["path"] == "agent.name")) & F.coalesce(F.lower(x["value"]) != F.lower(at["value"]), F.lit(True)))).otherwise(
            (x["path"] != "location") | ~x["value"].isin(*STATIC_PLACES)
        ),
    )
    return F.coalesce(fits, F.array().cast(f"array<{VALUE}>"))


def classified(path: Column, role: Column, value: Column, failure: Column, fim: Column, trusted: Mapping[str, Sequence[str]] | None = None, networks: Sequence[str] = addresses.INTERNAL_NETWORKS, service: Sequence[str] = SERVICE_ACCOUNTS) -> Column:
    """Struct of what a value may be in a condition: alone (it identifies a host), attacker (who attacks may choose it), external,
    internal, trusted, host_like, never, chosen (a name that someone picked). ``failure`` and ``fim`` tell of the rule's alerts."""
    trusted = trusted or {}
    by_name = context.trusted(path, value, trusted)
    by_role = F.lit(False)
    for r, name in TRUST_NAMES.items():
        by_role = by_role | ((role == r) & context.trusted(F.lit(name), value, trusted))
    vouched = by_name | by_role
    generic_exact = [p for p in GENERIC_PROCESSES if not set(p) & set("*?[")]
    generic = addresses.let(fn.process_name(value), lambda n: F.coalesce(n == "", F.lit(True)) | n.isin(*generic_exact) | any_glob(n, [p for p in GENERIC_PROCESSES if set(p) & set("*?[")], fold=False))
    shaped = F.struct(
        F.coalesce(vouched, F.lit(False)).alias("vouched"), F.when(role.isin("src_ip", "peer_ip"), addresses.kind(value, networks)).alias("ip"), F.when(role == "user", fn.is_machine_account(value)).alias("machine"),
        F.when(role == "user", addresses.let(fn.account_name(value), lambda n: any_glob(n, list(service)))).alias("service"), F.when(role == "process", generic).alias("generic"),
        F.when(role == "process", value.rlike(r"^(?:[A-Za-z]:[\\/]|\\\\|/)") & ~value.rlike(r"[*?]") & ~fn.user_writable(value)).alias("fixed"), F.when(path == "location", sender(value)).alias("place"),
    )

    def flags(s: Column) -> Column:
        is_ip, process, user = role.isin("src_ip", "peer_ip"), role == "process", role == "user"
        seed = user & failure & path.isin(*FAILURE_SENSITIVE)
        account = s["vouched"] | (~s["machine"] & s["service"])
        internal, place = is_ip & (s["ip"] == "internal"), F.coalesce(s["place"], F.lit(False))
        changed = (role == "file") & fim & path.isin(*CHANGED_FILES)
        attacker = F.when(role.isin("host", "source", "context"), F.lit(False)).when(is_ip, ~internal).when(user, seed | ~(account | s["machine"])).when(process, s["generic"] | ~s["fixed"]).otherwise(~changed)
        trusted_ = F.when(role.isin("host", "source"), s["vouched"]).when(is_ip, internal & s["vouched"]).when(user, ~seed & account).when(process, ~s["generic"] & s["fixed"] & s["vouched"]).otherwise(changed & s["vouched"])
        out = {
            "alone": (role == "host") | place | (internal & (role == "src_ip")) | changed, "attacker": attacker, "external": is_ip & (s["ip"] == "external"), "internal": internal, "trusted": trusted_,
            "host_like": (role == "host") | place, "never": process & s["generic"], "chosen": user & ~seed & ~s["vouched"],
        }
        return F.struct(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in out.items()])

    return addresses.let(shaped, flags)
