"""Fixed values that results depend on, in one place."""

# Luminance weights, hue bands (degrees, width), in-band minima.
LUMA = (0.2126, 0.7152, 0.0722)
TAZEL_HUE, TAZEL_SIGMA = 170, 24
VYRN_HUE, VYRN_SIGMA = 350, 28
SAT_MIN, VAL_MIN = 0.12, 0.08
EPS = 1e-6
MAX_PIXELS = 40_000_000

# Spectral triad and membership paints (hex), other paints (rgb).
TRIAD = {"tazel": "1EC9A5", "vyrn": "C00066", "zero": "6F6485"}
PAINT = {"zero": "325767", "chaos": "8D223D", "vyrn": "A22639", "uv": "9F3B2B", "tazel": "797A2D", "rosetta": "467542", "zen": "DFD2B5"}
PAINT_RGB = {"candle": (1.0, 0.62, 0.22), "indent": (0.72, 0.68, 0.58), "lemon": (0.62, 0.38, 0.14)}
DEFAULT_PAINT = (0.7, 0.7, 0.7)
WEIGHTS = {
    "rosetta": {"zero": 0.40, "tazel": 0.35, "vyrn": 0.25},
    "zen": {"zero": 0.25, "tazel": 0.25, "uv": 0.25, "vyrn": 0.25},
    "chaos": {"uv": 0.40, "vyrn": 0.35, "tazel": 0.20, "zero": 0.05},
}
MODES = ("zero", "tazel", "vyrn", "uv", "rosetta", "zen", "chaos", "balance", "candle", "indent", "lemon")
PAPERS = {
    "zero": "ZSA-1.0", "tazel": "TSA-1.0", "vyrn": "VSA-1.0", "uv": "UVSA-1.0", "rosetta": "RSA-2.0", "zen": "ZENA-1.0", "chaos": "CSA-1.0",
    "balance": "BSA", "candle": "CLSA-1.0", "indent": "ISA-1.0", "lemon": "LISA-1.0",
}
ALIASES = {
    "candlelight": "candle", "candle-light": "candle", "ultraviolet": "uv", "uv-light": "uv", "uvsa": "uv", "indentation": "indent", "suppress-ink": "indent",
    "ink-suppress": "indent", "revealer-indent": "indent", "lemon-ink": "lemon", "hidden-lemon": "lemon", "invisible-ink-lemon": "lemon",
}
STUBS = ("spectrometer", "forensic", "invent_mark")
PAGE_TARGETS = ("page", "parchment", "substrate", "folio")
INJECT_OFF = ("0", "false", "off", "no", "no-inject", "n")
INJECT_ON = ("1", "true", "on", "yes", "inject", "y")

# Pigment thresholds.
PIGMENT = {
    "floor": 0.045, "noise_k": 3.0, "gap_min": 0.02, "gap_max": 0.22, "chroma": 0.03, "pixels": 24, "frac_min": 0.004, "frac_max": 0.85, "near": 3, "gain": 1.7,
}
# Cover thresholds.
COVER = {"opaque_luma": 0.045, "luma": 0.42, "std": 0.028, "frac": 0.012, "pixels": 24, "opaque_std": 0.045, "opaque_max": 0.12, "opaque_share": 0.72, "range": 0.08}
TWIN_DELTA = 0.08

# Refusal codes.
PIGMENT_GONE = "SL-PIGMENT-GONE"
OPAQUE = "SL-UNREDACT-OPAQUE"
NO_INK = "SL-HANDWRITING-NO-INK"
UNSUPPORTED = "SL-RECOVER-UNSUPPORTED"


def rgb_of(code: str) -> tuple[float, float, float]:
    return tuple(int(code[i : i + 2], 16) / 255 for i in (0, 2, 4))


def paint(mode: str) -> tuple[float, float, float]:
    if mode in PAINT:
        return rgb_of(PAINT[mode])
    if mode == "balance":
        return tuple((a + b) / 2 for a, b in zip(rgb_of(PAINT["zen"]), rgb_of(PAINT["chaos"]), strict=True))
    return PAINT_RGB.get(mode, DEFAULT_PAINT)
