"""Names and codes of the routing protocols. Fixed values, as their registries list them."""

from __future__ import annotations

# -- fixed values: message types
MESSAGE_TYPES = {"OPEN": 1, "UPDATE": 2, "NOTIFICATION": 3, "KEEPALIVE": 4, "ROUTE_REFRESH": 5, "CLOSE": 255}

# -- fixed values: path attributes
ATTRIBUTES = {
    "ORIGIN": 1, "AS_PATH": 2, "NEXT_HOP": 3, "MULTI_EXIT_DISC": 4, "LOCAL_PREF": 5, "ATOMIC_AGGREGATE": 6, "AGGREGATOR": 7,
    "COMMUNITY": 8, "ORIGINATOR_ID": 9, "CLUSTER_LIST": 10, "DPA": 11, "ADVERTISER": 12, "RCID_PATH_CLUSTER_ID": 13,
    "MP_REACH_NLRI": 14, "MP_UNREACH_NLRI": 15, "EXTENDED_COMMUNITY": 16, "AS4_PATH": 17, "AS4_AGGREGATOR": 18, "SAFI_SSA": 19,
    "CONNECTOR": 20, "AS_PATHLIMIT": 21, "PMSI_TUNNEL": 22, "TUNNEL_ENCAPSULATION": 23, "TRAFFIC_ENGINEERING": 24,
    "IPV6_ADDRESS_SPECIFIC_EXTENDED_COMMUNITY": 25, "AIGP": 26, "PE_DISTINGUISHER_LABELS": 27, "ENTROPY_LEVEL_CAPABILITY": 28,
    "LS": 29, "LARGE_COMMUNITY": 32, "BGPSEC_PATH": 33, "COMMUNITY_CONTAINER": 34, "PREFIX_SID": 40, "SET": 128,
}
#: A spelling that older scripts use.
ATTRIBUTE_ALIASES = {"LOCAL_PREFI": 5}

# -- fixed values: well-known communities
COMMUNITIES = {
    "PLANNED_SHUT": 0xFFFF0000, "ACCEPT_OWN": 0xFFFF0001, "ROUTE_FILTER_TRANSLATED_V4": 0xFFFF0002, "ROUTE_FILTER_V4": 0xFFFF0003,
    "ROUTE_FILTER_TRANSLATED_V6": 0xFFFF0004, "ROUTE_FILTER_V6": 0xFFFF0005, "LLGR_STALE": 0xFFFF0006, "NO_LLGR": 0xFFFF0007,
    "ACCEPT_OWN_NEXTHOP": 0xFFFF0008, "STANDBY_PE": 0xFFFF0009, "BLACKHOLE": 0xFFFF029A, "NO_EXPORT": 0xFFFFFF01,
    "NO_ADVERTISE": 0xFFFFFF02, "NO_EXPORT_SUBCONFED": 0xFFFFFF03, "NO_PEER": 0xFFFFFF04,
}

# -- fixed values: capabilities
CAPABILITIES = {
    "RESERVED": 0, "MULTIPROTOCOL": 1, "ROUTE_REFRESH": 2, "COOPERATIVE_ROUTE_FILTERING": 3, "MULTIPLE_ROUTES_DEST": 4,
    "EXTENDED_NEXT_HOP": 5, "EXTENDED_MESSAGE": 6, "BGPSEC": 7, "MULTIPLE_LABELS": 8, "BGP_ROLE": 9, "GRACEFUL_RESTART": 64,
    "ASN32BIT": 65, "DYNAMIC_CISCO": 66, "DYNAMIC": 67, "MULTISESSION": 68, "ADD_PATH": 69, "ENHANCED_ROUTE_REFRESH": 70,
    "LONG_LIVED_GRACEFUL_RESTART": 71, "CP_ORF": 72, "FQDN": 73, "ROUTE_REFRESH_CISCO": 128, "ORF_CISCO": 130, "MULTISESSION_CISCO": 131,
}

# -- fixed values: line markers by message type
MARKERS = {1: ">", 3: "!", 4: "@", 5: "^", 255: "<"}

UPDATE, AS_TRANS = 2, 23456


def code_of(text: str, table: dict[str, int], what: str, most: int = 255) -> int:
    """A name of the table in either case, or a number: decimal, 0x hexadecimal, 0b binary or 0 octal."""
    found = table.get(text.upper())
    if found is not None:
        return found
    try:
        number = int(text, 8) if len(text) > 1 and text[0] == "0" and text.isdigit() else int(text, 0)
    except ValueError:
        number = -1
    if not 0 <= number <= most:
        raise ValueError(f"bad {what}: {text!r}")
    return number


def error_text(code: str) -> str:
    """An error code in words."""
    return code.replace("_", " ").lower().replace("mp reach", "MP_REACH_NLRI").replace("mp unreach", "MP_UNREACH_NLRI").replace("bgp4mp", "BGP4MP").replace("rib", "RIB").replace("afi safi", "AFI and SAFI")
