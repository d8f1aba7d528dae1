"""Native record schemas."""

from __future__ import annotations

EVENT = (
    "schema_version int, attempt_index int, sequence_index int, round_index int, implementation string, status string, "
    "returncode int, required_idle_seconds double, observed_idle_seconds double, started_at_utc string, "
    "finished_at_utc string, duration_seconds double, manifest string"
)
SAMPLE = (
    "run_id string, relative_sec double, power_w double, memory_used_mib double, gpu_utilization_percent int, "
    "memory_utilization_percent int, temperature_c int, graphics_clock_mhz int, memory_clock_mhz int, power_limit_w double, "
    "compute_process_count int, graphics_process_count int, throttle_reasons array<string>"
)
_ASSET = "struct<sha256: string, path: string, size_bytes: bigint>"
MANIFEST = (
    "status string, run_index bigint, product string, workload_id string, variant string, benchmark_contract_version bigint, "
    "parameters struct<frames: bigint, warmup_frames: bigint, encoder: map<string, string>, execution_profile: string, "
    "vspipe_requests: string, num_streams: bigint, vapoursynth_threads: string, cuda_graph: boolean>, "
    f"assets struct<input: {_ASSET}, onnx: {_ASSET}, engine: {_ASSET}, workload_manifest: {_ASSET}>, "
    "environment struct<image: struct<id: string, repository_revision: string, source_dirty: string>, "
    "gpu: map<string, string>, cpu: map<string, string>>, "
    "reproducibility struct<publishable: boolean, errors: array<string>>, "
    "measured struct<metrics: struct<end_to_end_fps: double, wall_time_sec: double, "
    "cpu: struct<accounting: string, scope: string, available_logical_cpus: bigint, average_cores: double, capacity_percent: double>, "
    "lifecycle: struct<clock: string, boundary_contract: string, startup_sec: double, steady_state_frame_loop_sec: double, "
    "finalize_mux_sec: double, total_sec: double, detailed: struct<intervals_sec: map<string, double>>>, "
    "nvml: struct<utilization: struct<average_gpu_percent: double>, power: struct<average_w: double, joules_per_frame: double, "
    "power_cap_observed: boolean>, memory: struct<peak_delta_mib: double>, temperature: struct<peak_c: double>, "
    "throttle_reasons: array<string>>>, "
    "validation: struct<valid: boolean, observed: struct<video_bitrate_bps: double>>, output: struct<size_bytes: double>>, "
    "errors array<string>"
)
TRACE_TABLES = (
    "CUPTI_ACTIVITY_KIND_KERNEL", "CUPTI_ACTIVITY_KIND_MEMCPY", "ENUM_CUDA_MEMCPY_OPER", "ENUM_VIDEO_ENGINE_TYPE",
    "GPU_VIDEO_ENGINE_WORKLOAD", "NVTX_EVENTS", "StringIds",
)
EVENT_STATUSES = ("completed", "failed")
# Enum names in trace tables and the direction or engine they stand for.
COPY_KINDS = {"CUDA_MEMCPY_KIND_HTOD": "h2d", "CUDA_MEMCPY_KIND_DTOH": "d2h", "CUDA_MEMCPY_KIND_DTOD": "d2d"}
VIDEO_ENGINES = {"NVDEC": "decode", "NVENC": "encode"}
