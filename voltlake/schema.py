"""Tables of the engine, as DDL. Samples come LONG (a row a sample) or as traces (an array a channel)."""

RECORDING = "recording_id string, signal_type string, sampling_rate double, n_channels int, n_samples bigint, duration_s double, recording_start timestamp, is_segmented boolean, is_averaged boolean, source_path string"
CHANNEL = "recording_id string, channel_index int, channel_name string, role string, impedance_kohm double, is_bad boolean, is_hidden boolean, is_interpolated boolean"
SAMPLE = "recording_id string, channel_index int, sample_index bigint, value double"
TRACE = "recording_id string, channel_index int, sampling_rate double, values array<float>"
EVENT = "recording_id string, event_id string, code string, label string, description string, cell string, begin_s double, raw_begin string, source_file string, duration_s double"
SEGMENT = "recording_id string, segment_id string, segment_index int, kind string, category string, start_sample bigint, end_sample bigint, stimulus_offset int, source_code string, source_time_s double, contributing int"
INTERVAL = "recording_id string, artifact_id string, code string, start_sample bigint, end_sample bigint"
LAYOUT = "channel_index int, x double, y double"
GEOMETRY = "channel_index int, x double, y double, z double"
MOTION = "volume int, roll double, pitch double, yaw double, d_s double, d_l double, d_p double"
REJECTION = "array<struct<category:string,total:int,included:int,reasons:map<string,int>>>"
STEP = f"seq int, op string, parameters map<string,string>, replayable boolean, note string, rejections {REJECTION}"

#: The resting bands, low and high edge in Hz.
BANDS = (("Delta", 1.0, 4.0), ("Theta", 4.0, 8.0), ("Alpha", 8.0, 13.0), ("Beta", 13.0, 30.0), ("Low Gamma", 30.0, 45.0))
