"""A small dirty table of weather stations, made by rule, used as a fixture."""

SOILS, ZONES, POWERS = ("clay", "loam"), ("north", "south", "hills"), ("solar", "mains", "battery", "wind")


def _station(i: int) -> str:
    altitude = "" if i in (5, 17) else str(120 + 37 * i % 410)
    days = 4000 if i == 11 else 3 + 7 * i % 60
    crop = {7: "unknown", 13: "$310.50", 19: ""}.get(i, f"{12 + i * 5.5}")
    return (
        f"ST-{i:02d},Keeper {chr(65 + i)},{altitude},{SOILS[i % 3 == 0]},{days},2021-{1 + i % 12:02d}-{1 + 3 * i % 28:02d},{20 + 13 * i % 71 + 0.25},"
        f"{crop},{ZONES[i % 5 % 3]},{POWERS[i % 7 % 4]},{'yes' if i % 4 == 1 else 'no'}"
    )


STATIONS = [_station(i) for i in range(24)]
# Two stations were entered twice.
STATION_CSV = "\n".join(["station_id,keeper,altitude,soil,days_active,installed,moisture,yield_text,zone,power,failed", *STATIONS, STATIONS[2], STATIONS[9]]) + "\n"
