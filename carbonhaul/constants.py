"""Domain constants.

Fixed values: every number below takes part in a result, so it is stated as published and
not tuned here.
"""

# Emissions and prices
CO2_KG_PER_LITRE = 2.68
DEFAULT_ETS_EUR_PER_T = 85.0
DEFAULT_FUEL_EUR_PER_L = 1.45

# Finance
DISCOUNT_RATE = 0.08
HORIZON_YEARS = 5
HORIZON_MONTHS = 60
NEVER_PAYS_BACK = 999.0

# Efficiency targets, L/100km
EFFICIENCY_TARGET = 28.0
INDUSTRY_BENCHMARK = 30.0

# Trips a vehicle could drive per day, used by the utilisation measure
POSSIBLE_TRIPS_PER_DAY = 30

# Geography
EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32

# Calendar dimension
CALENDAR_FIRST = "2024-01-01"
CALENDAR_LAST = "2030-12-31"

# Depot cities: name, latitude, longitude
CITIES = (
    ("Amsterdam", 52.3676, 4.9041),
    ("Berlin", 52.5200, 13.4050),
    ("Brussels", 50.8503, 4.3517),
    ("Copenhagen", 55.6761, 12.5683),
    ("Frankfurt", 50.1109, 8.6821),
    ("Hamburg", 53.5511, 9.9937),
    ("Madrid", 40.4168, -3.7038),
    ("Milan", 45.4642, 9.1900),
    ("Munich", 48.1351, 11.5820),
    ("Paris", 48.8566, 2.3522),
    ("Rome", 41.9028, 12.4964),
    ("Vienna", 48.2082, 16.3738),
    ("Warsaw", 52.2297, 21.0122),
    ("Zurich", 47.3769, 8.5417),
)

# Fuel card suppliers
SUPPLIERS = (
    "Shell Energy Europe",
    "TotalEnergies Fleet",
    "BP Commercial",
    "Eni Fuel Solutions",
    "Repsol Fleet Services",
)
