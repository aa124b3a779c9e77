"""Table and snapshot schemas, as Spark DDL."""

JOBS = """
    job_id string, name string, namespace string,
    submission_time timestamp, start_time timestamp, completion_time timestamp,
    cpu_request double, memory_request double, cpu_limit double, memory_limit double,
    priority int, user_name string, queue_name string, status string, job_type string,
    restart_count int, oom_killed boolean, metadata string
"""

CLUSTER_STATES = """
    id bigint, timestamp timestamp,
    total_cpu_capacity double, total_memory_capacity double,
    available_cpu double, available_memory double,
    pending_jobs_count int, running_jobs_count int, queue_length int, node_count int,
    avg_cpu_utilization double, avg_memory_utilization double, metadata string
"""

SCHEDULING_EVENTS = """
    id bigint, timestamp timestamp, job_id string, event_type string, scheduler_name string,
    queue_wait_time double, resource_efficiency double, decision_metadata string
"""

METRICS = """
    id bigint, timestamp timestamp, metric_name string, metric_value double,
    metric_type string, tags string
"""

_CONTAINERS = """array<struct<
    name: string,
    resources: struct<requests: map<string, string>, limits: map<string, string>>>>"""

JOB_MANIFEST = f"""
    snapshot_ts timestamp,
    metadata struct<uid: string, name: string, namespace: string, creationTimestamp: timestamp,
                    labels: map<string, string>, annotations: map<string, string>>,
    spec struct<suspend: boolean,
                template: struct<spec: struct<containers: {_CONTAINERS}>>,
                containers: {_CONTAINERS}>,
    status struct<active: int, succeeded: int, failed: int,
                  startTime: timestamp, completionTime: timestamp>
"""

WORKLOAD_MANIFEST = """
    snapshot_ts timestamp,
    metadata struct<uid: string, name: string, namespace: string,
                    labels: map<string, string>, annotations: map<string, string>>,
    spec struct<suspend: boolean, priority: int,
                podSets: array<struct<template: struct<spec: struct<containers: array<struct<
                    resources: struct<requests: map<string, string>>>>>>>>>,
    status struct<admitted: boolean>
"""

NODE_SNAPSHOT = """
    snapshot_ts timestamp, name string,
    capacity map<string, string>, allocatable map<string, string>,
    taints array<struct<key: string, effect: string>>,
    conditions array<struct<type: string, status: string>>
"""

_TERMINATED = "struct<terminated: struct<reason: string>>"

POD_SNAPSHOT = f"""
    snapshot_ts timestamp, namespace string, labels map<string, string>, phase string,
    container_statuses array<struct<state: {_TERMINATED}, last_state: {_TERMINATED}>>
"""

CLUSTER_EVENT = """
    namespace string, reason string, message string,
    first_timestamp timestamp, event_time timestamp
"""
