"""Record types and the value domains both contract checks share."""

from __future__ import annotations

FPS_TYPE = "struct<num:bigint,den:bigint>"

CLIP_TYPE = f"""
schema string, clip_id string, display_name string, source_path string,
source_in_sample bigint, source_out_sample bigint, source_sample_rate bigint,
source_channels bigint, audio_stream_index bigint, channel_map array<bigint>,
timeline_start_frame bigint, timeline_end_frame bigint, timeline_fps {FPS_TYPE},
source_fps {FPS_TYPE}, output_media_fps {FPS_TYPE}, project_sample_rate bigint,
handles_seconds double, file_duration_seconds double
"""

PARAMS_TYPE = """
schema string, model string, device string, segment double, overlap double,
shifts bigint, vocals_only_bag boolean, wet double, output_gain_db double,
mono boolean, sample_format string, enhancer string, resampler_id string,
clip_policy string, output_dir string, allowed_roots array<string>,
use_cache boolean, mode string, text_query string, speaker_id string,
ref_sample_t0 double, ref_sample_t1 double
"""

CLIP_RESULT_TYPE = """
clip_id string, input_hash string, output_path string, output_samples bigint,
handles_left_actual double, handles_right_actual double,
wet_dry_sample_rate bigint, peak double, cache_hit boolean
"""


def struct_type(fields: str) -> str:
    """A list of columns as the type of a struct column."""
    return f"struct<{', '.join(f.strip().replace(' ', ':', 1) for f in fields.split(','))}>"


JOB_TYPE = f"""
schema string, id string, created_at string, engine_version string,
params {struct_type(PARAMS_TYPE)}, clips array<{struct_type(CLIP_RESULT_TYPE)}>
"""

SIGNAL_TYPE = (
    "clip_id string, ch int, block_no bigint, start_sample bigint, "
    "n int, channels int, sample_rate int, samples array<float>"
)

EVENT_TYPE = """
job_id string, ts timestamp, seq bigint, event string,
data struct<clip_id:string, segment_offset:bigint, window_start:bigint,
audio_length:bigint, shift_idx:int, shifts:int, model_idx:int, models:int,
pct:double, pass:int, mode:string, message:string>
"""

# The closed value sets of the contracts.
MODELS = ("mel_band_roformer", "htdemucs", "htdemucs_ft")
DEVICES = ("auto", "mps", "cuda", "cpu")
SAMPLE_FORMATS = ("pcm24", "float32")
ENHANCERS = ("none", "deepfilternet3")
RESAMPLERS = ("soxr_hq_v1",)
CLIP_POLICIES = ("no_demucs_rescale",)
MODES = ("music", "tse", "audiosep")
MAX_SEGMENT_S = 7.8
GAIN_DB_RANGE = (-12.0, 12.0)

# Version tags of our own documents; pass others to read foreign ones.
CLIP_TAG = "stemtable.clip.v1"
PARAMS_TAG = "stemtable.params.v1"
JOB_TAG = "stemtable.job.v1"
