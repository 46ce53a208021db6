"""Protocols, services, addresses and directions as Column expressions."""

from __future__ import annotations

from ipaddress import IPv4Network, ip_network
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.functions.text import strip

# IP protocol numbers named when flows are stored.
SERVING_PROTOCOLS = {
    "1": "ICMP",
    "6": "TCP",
    "17": "UDP",
    "41": "ENCAP",
    "47": "GRE",
    "50": "ESP",
    "51": "AH",
    "58": "ICMPv6",
    "132": "SCTP",
}
# IP protocol numbers named when packets are captured.
CAPTURE_PROTOCOLS = {
    "1": "ICMP",
    "6": "TCP",
    "17": "UDP",
    "47": "GRE",
    "50": "ESP",
    "51": "AH",
    "58": "ICMPV6",
    "132": "SCTP",
}
# Protocol codes of the feature vector.
PROTOCOL_CODES = {"ICMP": 1, "TCP": 6, "UDP": 17, "GRE": 47, "ESP": 50, "AH": 51, "SCTP": 132}
# Service by well-known port.
PORT_SERVICES = {
    20: "ftp",
    21: "ftp",
    22: "ssh",
    23: "telnet",
    25: "smtp",
    53: "dns",
    67: "dhcp",
    68: "dhcp",
    80: "http",
    110: "pop3",
    123: "ntp",
    135: "rpc",
    143: "imap",
    161: "snmp",
    389: "ldap",
    443: "https",
    445: "smb",
    465: "smtps",
    993: "imaps",
    995: "pop3s",
    1433: "mssql",
    1521: "oracle",
    3306: "mysql",
    3389: "rdp",
    5060: "sip",
}
# IPv4 blocks that count as private, and the addresses inside them that do not.
PRIVATE_V4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
)
PUBLIC_V4 = ("192.0.0.9/32", "192.0.0.10/32")
# The same for IPv6 (v4-mapped addresses follow the IPv4 table).
PRIVATE_V6 = (
    "::1/128",
    "::/128",
    "64:ff9b:1::/48",
    "100::/64",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "fc00::/7",
    "fe80::/10",
)
PUBLIC_V6 = (
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IPV4_PATTERN = rf"^{_QUAD}$"
_GROUPS = r"[0-9a-f]{1,4}(:[0-9a-f]{1,4})*"
_IPV6_SHAPE = rf"^({_GROUPS})?(::({_GROUPS})?)?$"


def _dotted_pattern(blocks: tuple) -> str:
    """Pattern for the leading part of dotted quads inside any of the blocks."""
    options = []
    for block in blocks:
        net = IPv4Network(block)
        whole, part = divmod(net.prefixlen, 8)
        low, high = net.network_address.packed, net.broadcast_address.packed
        pieces = [str(low[i]) for i in range(whole)]
        if part:
            pieces.append("(?:" + "|".join(str(v) for v in range(low[whole], high[whole] + 1)) + ")")
        options.append(r"\.".join(pieces) + (r"\." if len(pieces) < 4 else "$"))
    return "(?:" + "|".join(options) + ")"


def _hex_pattern(blocks: tuple, lead: str = "") -> str:
    """The same for addresses written as plain hex digits."""
    options = []
    for block in blocks:
        net = ip_network(block)
        digits = net.max_prefixlen // 4
        low, high = (f"{int(a):0{digits}x}" for a in (net.network_address, net.broadcast_address))
        whole, part = divmod(net.prefixlen, 4)
        pattern = lead + low[:whole]
        if part:
            pattern += "[" + "".join(f"{v:x}" for v in range(int(low[whole], 16), int(high[whole], 16) + 1)) + "]"
        options.append(pattern)
    return "(?:" + "|".join(options) + ")"


# Whole tests as one pattern each, so a plan holds a single reference to the address.
_PRIVATE_DOTTED = rf"^(?!{_dotted_pattern(PUBLIC_V4)})(?={_dotted_pattern(PRIVATE_V4)}){_QUAD}$"
_MAPPED = "0" * 20 + "ffff"
_PRIVATE_HEX = (
    f"^(?!{_hex_pattern(PUBLIC_V6)}|{_hex_pattern(PUBLIC_V4, _MAPPED)})"
    f"(?:{_hex_pattern(PRIVATE_V6)}|{_hex_pattern(PRIVATE_V4, _MAPPED)})"
)


def _lookup(table: dict, key: Column) -> Column:
    literals = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items())
    return F.try_element_at(F.create_map(*literals), key)


def _protocol_name(c: Column, table: dict) -> Column:
    text = strip(c)
    return (
        F.when(c.isNull() | (text == ""), F.lit("OTHER"))
        .when(text.rlike(r"^\p{Nd}+$"), F.coalesce(_lookup(table, text), F.concat(F.lit("PROTO_"), text)))
        .otherwise(F.upper(text))
    )


def protocol_name(c: Column) -> Column:
    """Protocol as stored with a flow."""
    return _protocol_name(c, SERVING_PROTOCOLS)


def capture_protocol_name(c: Column) -> Column:
    """Protocol as written by the packet reader."""
    return _protocol_name(c, CAPTURE_PROTOCOLS)


def protocol_code(c: Column) -> Column:
    """Numeric code of an upper-case protocol name, 0 when unknown."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("double")).otherwise(
        F.coalesce(_lookup(PROTOCOL_CODES, c), F.lit(0)).cast("double")
    )


def infer_service(
    proto: Column, src_port: Column, dst_port: Column, dns_query: Column, http_method: Column, ssl_version: Column
) -> Column:
    port = F.coalesce(F.nullif(dst_port, F.lit(0)), F.nullif(src_port, F.lit(0)))
    present = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when(present(http_method), F.lit("http"))
        .when(ssl_version.isNotNull() | dst_port.isin(443, 8443), F.lit("https"))
        .when(present(dns_query) | (dst_port == 53), F.lit("dns"))
        .otherwise(F.coalesce(_lookup(PORT_SERVICES, port.cast("int")), F.lower(proto)))
    )


# --- addresses ---


def ipv4_number(ip: Column) -> Column:
    """Dotted quad to its 32-bit number, null when it is not one."""
    octet = [F.get(F.split(ip, r"\."), F.lit(i)).cast("bigint") for i in range(4)]
    folded = ((octet[0] * 256 + octet[1]) * 256 + octet[2]) * 256 + octet[3]
    return F.when(ip.rlike(IPV4_PATTERN), folded)


def ipv6_hex(ip: Column) -> Column:
    """IPv6 text to its 32 hex digits, null when it is not an address."""
    plain = F.lower(F.regexp_replace(ip, "%[^%]+$", ""))
    # A dotted tail stands for the last two groups; it is put in place at the end.
    text = F.regexp_replace(plain, rf"(?<=:){_QUAD}$", "0:0")
    # Each group to four digits: zeros in front, then all but the last four dropped.
    padded = F.regexp_replace(F.regexp_replace(text, "(?<![0-9a-f])([0-9a-f]{1,4})", "000$1"), "[0-9a-f]*([0-9a-f]{4})(?=:|$)", "$1")
    absent = F.lit(32) - F.length(F.replace(padded, F.lit(":"), F.lit("")))
    filled = F.replace(F.replace(padded, F.lit("::"), F.repeat(F.lit("0"), absent)), F.lit(":"), F.lit(""))
    fits = F.when(F.contains(text, F.lit("::")), absent >= 4).otherwise(absent == 0)
    base = F.when(F.contains(ip, F.lit(":")) & text.rlike(_IPV6_SHAPE) & fits, filled)
    tail = F.hex(ipv4_number(F.regexp_extract(plain, rf":({_QUAD})$", 1)))
    return F.when(
        F.contains(plain, F.lit(".")), F.concat(F.substring(base, 1, 24), F.lower(F.lpad(tail, 8, "0")))
    ).otherwise(base)


def is_private_ip(ip: Column, digits: Column | None = None) -> Column:
    """True for private, documentation, loopback and reserved addresses; invalid text is false.

    `digits` is ipv6_hex(ip) where a plan already has it as a column.
    """
    digits = ipv6_hex(ip) if digits is None else digits
    private = F.when(F.contains(ip, F.lit(":")), digits.rlike(_PRIVATE_HEX)).otherwise(ip.rlike(_PRIVATE_DOTTED))
    return F.coalesce(private, F.lit(False))


def stable_hash(text: Column) -> Column:
    """First 32 bits of the SHA-1 of the text as a number."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint")


def hashed_category(text: Column, modulus: int) -> Column:
    return stable_hash(text) % F.lit(modulus).cast("bigint")


def ip_number(ip: Column, digits: Column | None = None) -> Column:
    """Address as a double: IPv4, IPv6, a hash for other text, 0 for none."""
    digits = ipv6_hex(ip) if digits is None else digits
    half = lambda at: F.conv(F.substring(digits, at, 16), 16, 10).cast("double")
    wide = half(1) * 2.0**64 + half(17)
    text = F.coalesce(ip, F.lit(""))
    hashed = hashed_category(text, 2**31).cast("double")
    return (
        F.when(text == "", F.lit(0.0))
        .when(F.contains(text, F.lit(":")), F.coalesce(wide, hashed))
        .otherwise(F.coalesce(ipv4_number(ip).cast("double"), hashed))
    )


# --- directions ---


def direction_of(src_private: Column, dst_private: Column) -> Column:
    # An array lookup names each test once, however large its expression is.
    names = F.array(*[F.lit(n) for n in ("external", "inbound", "outbound", "internal")])
    return F.get(names, src_private.cast("int") * 2 + dst_private.cast("int"))


def direction_tag(src_ip: Column, dst_ip: Column) -> Column:
    return direction_of(is_private_ip(src_ip), is_private_ip(dst_ip))


def prefix_direction(src_ip: Column) -> Column:
    """Direction of a logged packet by address prefix; a missing source counts as outgoing."""
    return F.when(src_ip.isNull() | src_ip.startswith("192.168"), F.lit("out")).otherwise(F.lit("in"))
