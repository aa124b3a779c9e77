"""Resource quantity strings ("500m", "2Gi") as numeric columns in cores and GiB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recognised memory suffixes and their size in bytes.
MEMORY_UNITS = {
    "Ki": 1024,
    "Mi": 1024**2,
    "Gi": 1024**3,
    "Ti": 1024**4,
    "K": 1000,
    "M": 1000**2,
    "G": 1000**3,
    "T": 1000**4,
}
GIB = 1024**3

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def _is_blank(text: Column) -> Column:
    return text.isNull() | text.isin("", "0")


def parse_cpu(text: Column) -> Column:
    """Cores; blank is 0 and an unreadable quantity is NULL."""
    milli = _number(F.substr(text, F.lit(1), F.length(text) - 1)) / 1000.0
    return F.when(_is_blank(text), 0.0).when(text.endswith("m"), milli).otherwise(_number(text))


def parse_memory(text: Column) -> Column:
    """GiB; blank or unreadable bytes are 0, an unreadable number before a known unit is NULL."""
    unit = F.regexp_extract(text, "(" + "|".join(MEMORY_UNITS) + ")$", 1)
    sizes = F.create_map(*[F.lit(x) for unit_, size in MEMORY_UNITS.items() for x in (unit_, float(size))])
    scaled = _number(F.regexp_replace(text, "(" + "|".join(MEMORY_UNITS) + ")$", ""))
    return (
        F.when(_is_blank(text), 0.0)
        .when(unit != "", scaled * F.try_element_at(sizes, unit) / float(GIB))
        .otherwise(F.coalesce(_number(text) / float(GIB), F.lit(0.0)))
    )


def cpu_unreadable(text: Column) -> Column:
    """Where :func:`parse_cpu` gives NULL."""
    return ~(_is_blank(text) | text.rlike(_NUMBER.replace(r"\s*$", r"\s*m?$")))


def memory_unreadable(text: Column) -> Column:
    """Where :func:`parse_memory` gives NULL: a known unit after something that is no number."""
    units = "(" + "|".join(MEMORY_UNITS) + ")$"
    return text.isNotNull() & text.rlike(units) & ~text.rlike(_NUMBER.replace("$", units))


def first_container(containers: Column) -> Column:
    return F.try_element_at(containers, F.lit(1))


def quantity(resources: Column, kind: str, name: str, default: str = "0") -> Column:
    """The text of one entry of a container's requests or limits."""
    return F.coalesce(F.try_element_at(resources[kind], F.lit(name)), F.lit(default))


def container_resources(containers: Column) -> dict[str, Column]:
    """Requests and limits of the first container."""
    resources = first_container(containers)["resources"]
    return {
        "cpu_request": parse_cpu(quantity(resources, "requests", "cpu")),
        "memory_request": parse_memory(quantity(resources, "requests", "memory")),
        "cpu_limit": parse_cpu(quantity(resources, "limits", "cpu")),
        "memory_limit": parse_memory(quantity(resources, "limits", "memory")),
    }


def capacity_units(cores: Column, memory_gb: Column, used_cpu: Column, used_memory: Column) -> dict[str, Column]:
    """Node capacity in millicores and MB, with what is free and the share in use."""
    cpu, memory = cores * 1000, memory_gb * 1024
    return {
        "cpu_capacity": cpu,
        "memory_capacity": memory,
        "cpu_available": cpu - used_cpu,
        "memory_available": memory - used_memory,
        "cpu_utilization": F.try_divide(used_cpu, cpu),
        "memory_utilization": F.try_divide(used_memory, memory),
    }
