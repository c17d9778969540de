"""Distances on the globe and on the plane."""

from pyspark.sql import functions as F

from ..constants import EARTH_RADIUS_KM, KM_PER_DEGREE


def great_circle_km(lat1, lon1, lat2, lon2):
    """Spherical law of cosines.

    Close to 1 the cosine loses its digits and may even pass 1, where acos is NaN: equal end
    points are 0 by definition and the argument is clamped.
    """
    cosine = F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(
        F.radians(lon2) - F.radians(lon1)
    ) + F.sin(F.radians(lat1)) * F.sin(F.radians(lat2))
    arc = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))
    same = (lat1 == lat2) & (lon1 == lon2)
    return F.when(same, 0.0).otherwise(EARTH_RADIUS_KM * arc)


def planar_km(lat1, lon1, lat2, lon2):
    """Euclidean distance in degrees, scaled to kilometres."""
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2)) * KM_PER_DEGREE


def valid_position(lat, lon):
    return lat.isNotNull() & lon.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180)
