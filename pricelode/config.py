"""Parameters and small tables.

The tables in the sections marked "fixed values" must equal the published
constants for results to agree; everything may be overridden by the caller.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class WatchRule:
    """One watched model with its year range and variant patterns.

    ``variants`` keeps configuration order: the first variant all of whose
    patterns occur in the text wins.  ``body`` is the body word a listing must
    show on its detail page when the slug names model and drive but no body.
    """

    make: str
    model_slug: str
    make_display: str
    model_display: str
    year_min: int
    year_max: int
    variants: tuple[tuple[str, tuple[str, ...]], ...]
    card_anchor: str = ""
    search_slug: str = ""
    body: str | None = None
    body_model_pattern: str | None = None
    body_drive_pattern: str | None = None
    body_variant: str | None = None


# --- fixed values: base requirements ---------------------------------------
YEAR_MIN = 2022
YEAR_MAX = 2026
MILEAGE_MAX = 12000
GEARBOX_REQUIRED = "Automat"

# --- fixed values: watch list ----------------------------------------------
_VOLVO_VARIANTS = (("T6 AWD", (r"\bt6\b",)), ("T8 AWD", (r"\bt8\b",)))

WATCH_LIST: tuple[WatchRule, ...] = (
    WatchRule("volvo", "v60", "Volvo", "V60", 2023, 2026, _VOLVO_VARIANTS, "Volvo V60", "v60"),
    WatchRule("volvo", "v90", "Volvo", "V90", 2023, 2026, _VOLVO_VARIANTS, "Volvo V90", "v90"),
    WatchRule(
        "bmw", "530e-xdrive-touring", "BMW", "530e xDrive Touring", 2024, 2024,
        (("530e xDrive Touring", (r"530.?e",)),), "BMW 530e xDrive Touring", "530",
        "Touring", r"\b530\s*e\b", r"\bx\s*drive\b", "530e xDrive Touring",
    ),
    WatchRule(
        "bmw", "330e-xdrive-touring", "BMW", "330e xDrive Touring", 2024, 2026,
        (("330e xDrive Touring", (r"330.?e",)),), "BMW 330e xDrive Touring", "330",
        "Touring", r"\b330\s*e\b", r"\bx\s*drive\b", "330e xDrive Touring",
    ),
)

# --- fixed values: keyword tables ------------------------------------------
RENTAL_KEYWORDS = ("hyrbil", "bilpool", "leasingbil", "tjänstebil", "flikbil")
CERTIFIED_KEYWORDS = ("volvo selekt", "selekt")
BIG_BATTERY_KEYWORDS = ("18,8", "18.8")
TOW_HOOK_KEYWORDS = ("dragkrok",)
HEATER_KEYWORDS = ("värmare", "kupévärmare", "motorvärmare")

LEASING_KEYWORDS = (
    "privatleasing", "företagsleasing", "foretagsleasing", "leasingpris", "leasingkostnad",
    "leasingavgift", "leasing erbjudande", "leasing erbjuds", "leasing från", "leasing fr.",
    "månadspris", "manadspris", "månadsavgift", "manadsavgift", "kr/mån", "kr / mån",
    "kr/månaden", "kr per månad", "per månad", "per manad", "/månad", "/manad",
)
FORMER_LEASING_PHRASES = (
    "tidigare leasingbil", "tidigare leasing", "fd leasingbil", "f d leasingbil",
    "före detta leasingbil", "fore detta leasingbil", "leasinghistorik",
)
FALSE_WORDS = ("", "false", "0", "no", "nej", "n", "none", "null")

# --- fixed values: base prices (model, variant, year, price) ----------------
BASE_PRICES: tuple[tuple[str, str, int, int], ...] = (
    ("v60", "T6 AWD", 2022, 335000), ("v60", "T6 AWD", 2023, 375000), ("v60", "T6 AWD", 2024, 420000),
    ("v60", "T8 AWD", 2022, 375000), ("v60", "T8 AWD", 2023, 415000), ("v60", "T8 AWD", 2024, 460000),
    ("v90", "T6 AWD", 2022, 355000), ("v90", "T6 AWD", 2023, 395000), ("v90", "T6 AWD", 2024, 440000),
    ("v90", "T8 AWD", 2022, 395000), ("v90", "T8 AWD", 2023, 435000), ("v90", "T8 AWD", 2024, 480000),
    ("530e-xdrive-touring", "530e xDrive Touring", 2022, 315000),
    ("530e-xdrive-touring", "530e xDrive Touring", 2023, 355000),
    ("530e-xdrive-touring", "530e xDrive Touring", 2024, 395000),
    ("330e-xdrive-touring", "330e xDrive Touring", 2024, 430000),
    ("330e-xdrive-touring", "330e xDrive Touring", 2025, 470000),
    ("330e-xdrive-touring", "330e xDrive Touring", 2026, 520000),
)

# --- fixed values: equipment and option amounts -----------------------------
TRIM_AMOUNTS: tuple[tuple[str, int], ...] = (
    ("polestar engineered", 30000),
    ("inscription expression", 25000),
    ("inscription", 20000),
    ("ultimate", 15000),
    ("r design", 10000),
    ("rdesign", 10000),
    ("plus dark", 5000),
    ("plus", 0),
    ("momentum", 0),
    ("core", -15000),
)
OPTION_AMOUNTS: tuple[tuple[str, int], ...] = (
    ("tow_hook", 8000), ("heater", 4000), ("certified", 6000), ("big_battery", 12000),
)

# --- fixed values: score tables ---------------------------------------------
PRICE_POINTS: tuple[tuple[int, int], ...] = (
    (60000, 60), (55000, 56), (50000, 52), (45000, 48), (40000, 44), (35000, 40),
    (30000, 36), (27500, 33), (25000, 30), (22500, 27), (20000, 24), (17500, 21),
    (15000, 18), (12500, 15), (10000, 12), (7500, 9), (5000, 6), (2500, 3),
)
MILEAGE_POINTS: tuple[tuple[int, int], ...] = (
    (5000, 20), (6000, 19), (7000, 17), (8000, 15), (9000, 13),
    (10000, 11), (11000, 9), (12000, 7), (13000, 5), (14000, 3),
)
TRIM_POINTS: tuple[tuple[str, int], ...] = (
    ("ultimate", 5), ("plus", 4), ("inscription", 3), ("momentum", 2), ("core", 1),
    ("m sport", 5), ("luxury line", 4), ("advantage", 3), ("active edition", 3),
    ("sport line", 3), ("xline", 3),
)
SCORE_LEVELS: tuple[tuple[int, str], ...] = (
    (90, "🚨 EXTREMT FYND"), (80, "🔥 RIKTIGT FYND"), (70, "🟢 MYCKET INTRESSANT"),
    (60, "🟡 INTRESSANT"),
)
SCORE_LEVEL_DEFAULT = "⚪ BEVAKA"

# --- fixed values: status and basis-strength texts --------------------------
STRENGTH_LEVELS: tuple[tuple[int, str], ...] = ((8, "STARKT"), (5, "GODKÄNT"), (3, "SVAGT"))
STRENGTH_NONE = "OTILLRÄCKLIGT"
LEVEL_EXTREME = "EXTREMT_FYND"
LEVEL_BARGAIN = "FYND"
STATUS_SENT = "SKICKAS"
STATUS_LOW_SCORE = "STOPP: score < {min_score}"
STATUS_ALERTED = "STOPP: väntar på minst 15 000 kr lägre prisnivå"
TREND_UP, TREND_DOWN, TREND_FLAT = "upp", "ned", "oforandrad"
TREND_STABLE, TREND_INSUFFICIENT = "stabil", "otillrackligt_underlag"
KIND_LISTING, KIND_VALUATION = "annons", "marknadsvarde"


@dataclass(frozen=True)
class RequirementParams:
    watch_list: tuple[WatchRule, ...] = WATCH_LIST
    year_min: int = YEAR_MIN
    year_max: int = YEAR_MAX
    mileage_max: int = MILEAGE_MAX
    gearbox: str = GEARBOX_REQUIRED
    exclude_damaged: bool = True


@dataclass(frozen=True)
class MatchParams:
    mileage_margin: int = 300
    price_margin: int = 5000
    score_gate: int = 82
    review_below: int = 90
    variant_rewrites: tuple[tuple[str, str], ...] = (
        ("x drive", "xdrive"), ("4 motion", "4motion"), ("plug in", "plugin"),
    )


@dataclass(frozen=True)
class MarketParams:
    min_comparables: int = 3
    max_comparables: int = 15
    near_band: int = 1500
    wide_band: int = 3000
    price_per_mileage: float = 12.0
    min_mileage: int = 1000
    min_price: int = 100000
    max_price: int = 2000000
    equipment_cap: int = 40000
    expected_mileage_per_year: int = 1800
    trim_amounts: tuple[tuple[str, int], ...] = TRIM_AMOUNTS
    option_amounts: tuple[tuple[str, int], ...] = OPTION_AMOUNTS
    base_prices: tuple[tuple[str, str, int, int], ...] = BASE_PRICES
    default_model: str = "v60"
    extreme_diff: int = 35000
    extreme_pct: float = 8.0
    bargain_diff: int = 20000
    bargain_pct: float = 5.0
    # Nearest candidates kept per market point beyond ``max_comparables`` so
    # that a listing's own copies can be left out (see operators.market).
    identity_slack: int = 9


@dataclass(frozen=True)
class ScoreParams:
    price_points: tuple[tuple[int, int], ...] = PRICE_POINTS
    mileage_points: tuple[tuple[int, int], ...] = MILEAGE_POINTS
    trim_points: tuple[tuple[str, int], ...] = TRIM_POINTS
    equipment_max: int = 5
    auction_deduction: int = 10
    min_score: int = 60
    min_diff: int = 15000
    min_mileage: int = 1000
    report_rows: int = 20


@dataclass(frozen=True)
class StateParams:
    relevant_drop: int = 15000
    relevant_days: int = 14
    realert_drop: int = 15000


@dataclass(frozen=True)
class TrendParams:
    window_days: int = 14
    min_days: int = 2
    step_percent: float = 1.0
    timezone: str = "Europe/Stockholm"


@dataclass(frozen=True)
class Params:
    requirements: RequirementParams = field(default_factory=RequirementParams)
    matching: MatchParams = field(default_factory=MatchParams)
    market: MarketParams = field(default_factory=MarketParams)
    score: ScoreParams = field(default_factory=ScoreParams)
    state: StateParams = field(default_factory=StateParams)
    trend: TrendParams = field(default_factory=TrendParams)

# --- registration numbers on pages (fixed values) ---------------------------------

REG_LABEL = r"(?:\bregistreringsnummer\b|\bregistreringsnr\b|\breg\.?\s*nr\.?|\bregnr\b|\breg\.?\s*nummer\b)"
REG_KEYS = (
    "registrationnumber",
    "registration_number",
    "registrationno",
    "registration_no",
    "registernumber",
    "reg_number",
    "regnr",
    "registration",
)
# Attribute names may also just contain one of these.
REG_KEY_WORDS = ("registration", "regnr")
# Characters behind a label that are searched, first and second pass.
REG_NEAR, REG_FAR = 30, 100

# --- lengths of shown texts (fixed values) ------------------------------------------

CARD_TRIM_LENGTH = 60
REPORT_VARIANT_LENGTH = 80
REJECTED_SAMPLE = 5
