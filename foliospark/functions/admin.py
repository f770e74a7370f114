"""Capacity and hardware rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: GPU memory in MB and the context length that it carries, largest first.
CONTEXT_BY_VRAM = ((24000, 262144), (16000, 131072), (12000, 65536), (8000, 32768))
#: MB for a tenant and kept free, of memory and of disk.
MEMORY_PER_TENANT, MEMORY_RESERVE, DISK_PER_TENANT, DISK_RESERVE = 800, 4096, 1024, 51200
#: Tenants of a tier and its questions a minute.
RATE_TIERS = ((50, 15), (20, 10), (10, 6), (0, 4))


def recommended_context(vram: Column) -> Column:
    """The context length of the first threshold that is met; null if none is (F-66)."""
    out = None
    for least, size in CONTEXT_BY_VRAM:
        out = F.when(vram >= least, size) if out is None else out.when(vram >= least, size)
    return out


def max_tenants(memory: Column, disk: Column) -> Column:
    """How many tenants memory and disk carry, one at least (F-65)."""
    by_memory, by_disk = F.floor((memory - MEMORY_RESERVE) / MEMORY_PER_TENANT), F.floor((disk - DISK_RESERVE) / DISK_PER_TENANT)
    return F.greatest(F.least(by_memory, by_disk), F.lit(1)).cast("int")


def rate(tenants: Column) -> Column:
    """Questions a minute for a capacity (F-65)."""
    out = None
    for least, qpm in RATE_TIERS:
        out = F.when(tenants >= least, qpm) if out is None else out.when(tenants >= least, qpm)
    return out


def upload_rate(qpm: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(qpm / 3)).cast("int")


def admission(used: Column, most: Column) -> Column:
    """reject at the limit, warn from 90 % on (G-05)."""
    return F.when(used >= most, "reject").when(used >= 0.9 * most, "warn").otherwise("ok")


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, side: Column) -> Column:
    """Degrees of an image's position, negative in the south and west (S-07)."""
    size = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(side.isin("S", "W"), -size).otherwise(size)
