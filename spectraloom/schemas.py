"""Fixed schemas of the tables the operators exchange."""

# one row per pixel; absent rows are masked pixels
SPECTRA = "sample_id string, side string, row int, col int, spectrum array<double>"
CLUSTERS = "sample_id string, row int, col int, cluster int"
SELECTION = "sample_id string, raw double"
SAMPLES = "sample_id string, animal_id string, grp string, batch int"
BACKGROUNDS = "sample_id string, priority int, spectrum array<double>"
RECTS = "region string, sample_id string, r0 int, r1 int, c0 int, c1 int"
