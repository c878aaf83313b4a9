"""Roster saves: the chunk directory and the team colours."""

from __future__ import annotations

import os
import shutil
import struct

# Fixed values of the save format: data base, directory place and record size, the colour chunk and its fields, team order.
DATA_BASE, DIRECTORY, RECORD = 0xB28, 0x0C, 12
COLOUR_CHUNK, COLOUR_STRIDE = 0x8489FAF3, 412
INDEX_AT, TEAM_AT, PRIMARY_AT, SECONDARY_AT = 0x12B, 0x12C, 0x14C, 0x14F
TEAMS = "ANA ATL BOS BUF CGY CAR CHI COL CBJ DAL DET EDM FLA LAK MIN MTL NSH NJD NYI NYR OTT PHI PHO PIT SJS STL TBL TOR VAN WSH".split()


class NotARoster(ValueError):
    """The save lacks what it must have."""


def chunks(data: bytes) -> list[dict]:
    """(index, hash, count, off, foff, size) of the directory, a size being the way to the next offset."""
    if len(data) < DIRECTORY:
        raise NotARoster("too short")
    n = struct.unpack_from(">I", data, 8)[0]
    if not 0 < n < 4096 or len(data) < DIRECTORY + n * RECORD:
        raise NotARoster(f"{n} chunks")
    rows = [dict(zip(("hash", "count", "off"), struct.unpack_from(">3I", data, DIRECTORY + RECORD * k)), index=k) for k in range(n)]
    by_offset = sorted(rows, key=lambda r: (r["off"], r["index"]))
    for r, after in zip(by_offset, [*(r["off"] for r in by_offset[1:]), len(data) - DATA_BASE]):
        r |= {"foff": DATA_BASE + r["off"], "size": after - r["off"]}
    return rows


def colour_table(data: bytes) -> tuple[int, int]:
    """(base, stride) of the team records: the place where thirty of them name themselves; refused otherwise."""
    for c in (c for c in chunks(data) if c["hash"] == COLOUR_CHUNK):
        own = c["size"] // c["count"] if c["count"] else 0
        for stride in dict.fromkeys(s for s in (own, COLOUR_STRIDE) if s >= 200):
            for shift in range(-16, 17):
                base = c["foff"] + shift * stride
                if base < 0 or base + (len(TEAMS) - 1) * stride + TEAM_AT >= len(data):
                    continue
                if all(data[base + k * stride + INDEX_AT] == data[base + k * stride + TEAM_AT] == k for k in range(len(TEAMS))):
                    return base, stride
    raise NotARoster("no run of thirty team records")


def team_colours(data: bytes, led: bool = False) -> list[dict]:
    """(team, primary, secondary) as RRGGBB; the lights' colours are the thirty records behind the teams'."""
    base, stride = colour_table(data)
    place = lambda k: base + (k + len(TEAMS) * led) * stride
    return [{"team": t, "primary": data[place(k) + PRIMARY_AT :][:3].hex(), "secondary": data[place(k) + SECONDARY_AT :][:3].hex()} for k, t in enumerate(TEAMS)]


def blank(colours: list[tuple[str, str]]) -> bytes:
    """A save that holds colours (primary, secondary as RRGGBB) of the teams, then of their lights, and nothing else."""
    body = bytearray(COLOUR_STRIDE * (2 * len(TEAMS) + 10))
    for k, pair in enumerate(colours):
        at = k * COLOUR_STRIDE
        body[at + INDEX_AT], body[at + TEAM_AT] = k, k % len(TEAMS)
        for place, value in zip((PRIMARY_AT, SECONDARY_AT), pair):
            body[at + place : at + place + 3] = bytes.fromhex(value)
    head = bytearray(DATA_BASE)
    struct.pack_into(">I", head, 8, 1)
    struct.pack_into(">3I", head, DIRECTORY, COLOUR_CHUNK, len(body) // COLOUR_STRIDE, 0)
    return bytes(head + body)


def with_colour(data: bytes, team: str, primary: str | None = None, secondary: str | None = None, led: bool = False) -> bytes:
    """The save with a team's colours set in place; its length never changes."""
    base, stride = colour_table(data)
    at = base + (TEAMS.index(team.upper()) + len(TEAMS) * led) * stride
    out = bytearray(data)
    for place, value in ((PRIMARY_AT, primary), (SECONDARY_AT, secondary)):
        if value is not None:
            out[at + place : at + place + 3] = bytes.fromhex(value)
    return bytes(out)


def save(path: str, data: bytes, backup: bool = True) -> None:
    """Write a save in place, never at another length. What it was before the first change stays beside it as .colorbak."""
    if len(data) != os.path.getsize(path):
        raise ValueError("a save may not change its length")
    if backup and not os.path.exists(f"{path}.colorbak"):
        shutil.copy2(path, f"{path}.colorbak")
    with open(path, "r+b") as f:
        f.write(data)
