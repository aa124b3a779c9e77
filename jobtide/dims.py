"""Small configuration tables. Their row counts are fixed, so they may always be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: they must equal the configured defaults for results to agree. ---

TEMPLATES = [
    # name, task_name, category, cpu_request, memory_request, cpu_limit, memory_limit, minutes, priority
    ("cpu-intensive", "cpu-task", "cpu-intensive", "1000m", "2Gi", "2000m", "4Gi", 30, 5),
    ("memory-intensive", "memory-task", "memory-intensive", "500m", "4Gi", "1000m", "8Gi", 45, 4),
    ("io-intensive", "io-task", "io-intensive", "300m", "1Gi", "600m", "2Gi", 25, 3),
    ("ml-training", "ml-training", "ml-training", "2000m", "8Gi", "4000m", "16Gi", 60, 8),
    ("etl-pipeline", "etl-pipeline", "etl", "1500m", "6Gi", "3000m", "12Gi", 40, 6),
    ("quick-task", "quick-task", "lightweight", "100m", "256Mi", "200m", "512Mi", 5, 2),
]

NODE_CLASSES = [
    # count, cpu_cores, cpu_ghz, memory_gb, gpu_count
    (4, 32, 3.5, 128, 2),
    (8, 16, 2.8, 64, 0),
    (4, 8, 2.4, 32, 0),
]

JOB_TYPES = [
    # name, cpu millicores, memory MB, duration seconds, priority (low, high), failure_rate
    ("batch", 500, 4000, 1024, 8192, 60, 3600, 1, 5, 0.05),
    ("ml_training", 2000, 16000, 4096, 32768, 1800, 14400, 3, 8, 0.08),
    ("web_service", 100, 1000, 512, 2048, 300, 86400, 6, 10, 0.05),
    ("data_processing", 1000, 8000, 2048, 16384, 600, 7200, 2, 6, 0.05),
    ("cron_job", 100, 500, 256, 1024, 30, 300, 1, 3, 0.05),
]

TIME_PATTERNS = [
    # start_hour, end_hour, share of each job type
    (9, 18, {"batch": 0.3, "ml_training": 0.2, "web_service": 0.3, "data_processing": 0.15, "cron_job": 0.05}),
    (18, 23, {"batch": 0.4, "ml_training": 0.3, "web_service": 0.1, "data_processing": 0.15, "cron_job": 0.05}),
    (23, 9, {"batch": 0.5, "ml_training": 0.25, "web_service": 0.05, "data_processing": 0.1, "cron_job": 0.1}),
]

HOURLY_PATTERNS = [
    # band, first hour, hour after the last, jobs per hour, template weights
    ("night", 0, 6, 2, {"etl-pipeline": 0.4, "memory-intensive": 0.3, "io-intensive": 0.2, "quick-task": 0.1}),
    ("morning", 6, 9, 3, {"quick-task": 0.3, "cpu-intensive": 0.3, "io-intensive": 0.2, "etl-pipeline": 0.2}),
    (
        "business",
        9,
        18,
        5,
        {"ml-training": 0.3, "cpu-intensive": 0.25, "memory-intensive": 0.2, "etl-pipeline": 0.15, "quick-task": 0.1},
    ),
    (
        "evening",
        18,
        24,
        4,
        {
            "etl-pipeline": 0.35,
            "ml-training": 0.25,
            "memory-intensive": 0.2,
            "io-intensive": 0.15,
            "quick-task": 0.05,
        },
    ),
]

SCENARIOS = [
    # name, duration seconds, arrival_rate, burst_probability, burst_size, node_failure_rate, large_job_ratio
    ("normal_load", 3600, 0.5, None, None, None, None),
    ("high_load", 3600, 2.0, None, None, None, None),
    ("burst_load", 3600, 0.3, 0.1, 20, None, None),
    ("resource_constrained", 3600, 0.8, None, None, 0.2, None),
    ("large_jobs", 3600, 0.3, None, None, None, 0.5),
]

TRANSITIONS = [
    # previous status, new status, event type
    ("Suspended", "Pending", "admitted"),
    ("Pending", "Running", "scheduled"),
    ("Running", "Succeeded", "completed"),
    ("Running", "Failed", "failed"),
    ("Pending", "Failed", "rejected"),
]

JOB_TYPE_CODES = {"spark": 0.8, "ml": 0.6, "batch": 0.4, "etl": 0.5, "realtime": 0.7, "generic": 0.2}
UNKNOWN_JOB_TYPE_CODE = 0.2

REWARD_WEIGHTS = {"throughput": 0.4, "utilization": 0.3, "wait_penalty": 0.2, "failure_penalty": 0.1}

RETENTION_DAYS = 30
COLLECTION_SECONDS = 10
MONITOR_SECONDS = 30
NOISE_SIGMA = 0.1
ANOMALY_RATE = 0.01

# --- End of fixed values. ---


def dim_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        TEMPLATES,
        "name string, task_name string, category string, cpu_request string, memory_request string, "
        "cpu_limit string, memory_limit string, estimated_duration int, priority int",
    )


def dim_node_types(spark: SparkSession) -> DataFrame:
    rows = [spec for count, *spec in NODE_CLASSES for _ in range(count)]
    return spark.createDataFrame(
        [(node_id, *spec, "worker") for node_id, spec in enumerate(rows)],
        "node_id int, cpu_cores int, cpu_ghz double, memory_gb int, gpu_count int, node_type string",
    )


def dim_job_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        JOB_TYPES,
        "name string, cpu_low int, cpu_high int, memory_low int, memory_high int, "
        "duration_low int, duration_high int, priority_low int, priority_high int, failure_rate double",
    )


def dim_time_patterns(spark: SparkSession) -> DataFrame:
    """One row per pattern and job type; shares are normalised to sum to one per pattern."""
    rows = [
        (order, start, end, job_type, share / sum(shares.values()))
        for order, (start, end, shares) in enumerate(TIME_PATTERNS)
        for job_type, share in shares.items()
    ]
    return spark.createDataFrame(
        rows, "pattern_order int, start_hour int, end_hour int, job_type string, share double"
    )


def dim_hourly_patterns(spark: SparkSession) -> DataFrame:
    """One row per hour band and template."""
    rows = [
        (order, band, first, last, rate, template, weight)
        for order, (band, first, last, rate, weights) in enumerate(HOURLY_PATTERNS)
        for template, weight in weights.items()
    ]
    return spark.createDataFrame(
        rows,
        "band_order int, band string, first_hour int, end_hour int, job_rate int, "
        "template string, weight double",
    )


def dim_scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SCENARIOS,
        "scenario string, duration int, arrival_rate double, burst_probability double, "
        "burst_size int, node_failure_rate double, large_job_ratio double",
    )


def dim_transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "prev_status string, new_status string, event_type string")
