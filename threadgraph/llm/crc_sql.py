"""CRC-32 in SQL, for counterparts of queries: DuckDB has no such function."""

#: One row, whose list ``crc`` has the checksum's table.
CRC_TABLE = """
SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS crc
FROM range(256) AS r(i)
"""


def crc32(text: str) -> str:
    """Expression over a text expression; ``crc`` has to be in scope."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"
