"""Class names and label maps, and the Column functions that apply them.

The tables are small and fixed, so they become literal maps or ordered conditions that the optimizer folds; no join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names and mappings that results depend on.
ALLOWED = (
    "Car", "Truck", "Vehicle blocking bike lane", "Burned vehicle", "Police car", "Pedestrian", "Worker", "Street vendor",
    "Residential trash bin", "Commercial dumpster", "Street sign", "Construction sign", "Traffic signal light",
    "Broken traffic lights", "Tree", "Overhanging branch", "Dumped trash", "Yard waste", "Glass/debris", "Pothole",
    "Unclear bike lane markings", "Utility pole", "Downed bollard", "Cone", "Streetlight outage", "Graffiti", "Bench",
    "Vehicle in bike lane", "Bicycle", "Scooter", "Wheelchair", "Bus", "Train", "Ambulance", "Fire truck", "Other",
)
COCO_TO_ALLOWED = {
    "car": "Car", "truck": "Truck", "bus": "Bus", "train": "Train", "motorcycle": "Other", "bicycle": "Bicycle", "airplane": "Other",
    "boat": "Other", "person": "Pedestrian", "traffic light": "Traffic signal light", "stop sign": "Street sign", "fire hydrant": "Other",
    "parking meter": "Other", "bench": "Bench", "potted plant": "Tree", "bird": "Other", "cat": "Other", "dog": "Other", "horse": "Other",
    "sheep": "Other", "cow": "Other", "elephant": "Other", "bear": "Other", "zebra": "Other", "giraffe": "Other",
    "bottle": "Glass/debris", "cup": "Glass/debris", "banana": "Dumped trash", "apple": "Dumped trash", "sandwich": "Dumped trash",
    "orange": "Dumped trash", "pizza": "Dumped trash", "donut": "Dumped trash", "cake": "Dumped trash",
}
FREE_LABELS = (
    ("person", "Pedestrian"), ("people", "Pedestrian"), ("human", "Pedestrian"), ("man", "Pedestrian"), ("woman", "Pedestrian"),
    ("vehicle", "Car"), ("automobile", "Car"), ("sedan", "Car"), ("suv", "Car"), ("van", "Truck"), ("pickup", "Truck"), ("lorry", "Truck"),
    ("bike", "Bicycle"), ("motorcycle", "Scooter"), ("motorbike", "Scooter"), ("sign", "Street sign"), ("traffic light", "Traffic signal light"),
    ("stoplight", "Traffic signal light"), ("signal", "Traffic signal light"), ("pole", "Utility pole"), ("post", "Utility pole"),
    ("trash", "Dumped trash"), ("garbage", "Dumped trash"), ("waste", "Dumped trash"), ("rubbish", "Dumped trash"), ("debris", "Glass/debris"),
    ("construction worker", "Worker"), ("road worker", "Worker"), ("maintenance worker", "Worker"),
)
STEP1 = {
    "person": "person", "train": "train", "potted plant": "vegetation", "car": "vehicle", "motorcycle": "vehicle", "bus": "vehicle",
    "truck": "vehicle", "bicycle": "mobility_device", "skateboard": "mobility_device", "traffic light": "traffic infrastructure",
    "fire hydrant": "traffic infrastructure", "stop sign": "traffic infrastructure", "parking meter": "traffic infrastructure",
    "bench": "street furniture", "chair": "street furniture", "couch": "street furniture", "dining table": "street furniture",
    "bird": "animal", "cat": "animal", "dog": "animal", "horse": "animal", "sheep": "animal", "cow": "animal", "elephant": "animal",
    "bear": "animal", "zebra": "animal", "giraffe": "animal", "bottle": "trash/waste", "wine glass": "trash/waste",
    "cup": "trash/waste", "fork": "trash/waste", "knife": "trash/waste", "spoon": "trash/waste", "bowl": "trash/waste",
    "banana": "trash/waste", "apple": "trash/waste", "sandwich": "trash/waste", "orange": "trash/waste", "broccoli": "trash/waste",
    "carrot": "trash/waste", "hot dog": "trash/waste", "pizza": "trash/waste", "donut": "trash/waste", "cake": "trash/waste",
    "toilet": "trash/waste",
}
COCO_NAMES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light", "fire hydrant", "stop sign",
    "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella",
    "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard",
    "surfboard", "tennis racket", "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange",
    "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant", "bed", "dining table", "toilet", "tv",
    "laptop", "mouse", "remote", "keyboard", "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase",
    "scissors", "teddy bear", "hair drier", "toothbrush",
)
#: Ids that the 91-class numbering leaves out; the 80 classes take the others in order.
COCO_GAPS = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83)
COCO_IDS = tuple(i for i in range(1, 91) if i not in COCO_GAPS)
KITTI_TO_COCO = {"Car": 2, "Van": 2, "Truck": 7, "Pedestrian": 0, "Person_sitting": 0, "Cyclist": 1, "Tram": 6, "Misc": 90, "DontCare": 91}
COCO_TO_KITTI = {0: "Pedestrian", 1: "Cyclist", 2: "Car", 3: "Cyclist", 5: "Car", 7: "Truck", 9: "Misc"}
BOX_KEYWORDS = {
    "potholes": ("road", "pavement"), "flooding": ("road", "pavement"), "faded bike lane": ("road", "lane", "stripe"),
    "downed bollard": ("bollard", "pole"), "down power line": ("wire", "line", "cable"), "dumped trash": ("trash", "debris"),
    "yard waste": ("tree", "branch", "leaves"), "graffiti": ("wall", "sign", "surface"), "broken street sign": ("sign",),
    "vehicle blocking bike lane": ("vehicle", "car", "truck"), "tree overhang": ("tree", "branch"),
}
LABEL_KEYWORDS = {
    "potholes": ("pothole", "potholes"), "downed bollard": ("downed bollard", "fallen bollard"),
    "down power line": ("downed power line", "fallen power line", "power cable"),
    "flooding": ("flood", "flooding", "standing water", "sewage"),
    "faded bike lane": ("faded bike lane", "worn bike lane", "unclear markings"),
    "broken street sign": ("broken street sign", "damaged sign", "missing sign"),
    "broken traffic light": ("broken traffic light", "malfunctioning signal", "non-working light"),
    "vehicle blocking bike lane": ("blocking bike lane", "parked in bike lane"),
    "vehicle blocking fire hydrant": ("blocking fire hydrant",), "vehicle blocking red curb": ("blocking red curb",),
    "dumped trash": ("dumped trash", "illegal dumping"), "yard waste": ("yard waste", "leaf pile", "branch pile"),
    "glass": ("glass shards", "broken glass"), "residential trash cans in the bike lane": ("residential trash can in bike lane",),
    "commercial dumpsters in the bike lane": ("commercial dumpster in bike lane",), "graffiti": ("graffiti", "spray paint"),
    "construction sign": ("construction sign",), "cone": ("construction cone", "orange cone"),
    "blocked road": ("blocked road", "closed road"), "streetlight outage": ("streetlight outage", "light is off"),
    "tree overhang": ("tree overhang", "overhanging branch"), "burned vehicle": ("burned vehicle",),
    "vehicle on jacks": ("vehicle on jacks", "vehicle on blocks"), "shattered windows": ("shattered window", "broken window"),
    "missing tires": ("missing tire", "no wheel"), "street vendors in bike lane": ("vendor in bike lane", "selling in bike lane"),
}
PROMPT_KEYS = ("person", "car", "truck", "bicycle", "motorcycle", "bus", "traffic light", "stop sign", "other")
VERBOSE = (
    "the provided image", "based on the analysis", "however,", "there are no", "no distinct", "no discernible", "no clear", "too blurry",
    "lacks clear details", "appears to be",
)
STEP1_PHRASES = {
    "vehicle": "car, van, truck, motorcycle", "person": "pedestrian, worker, vendor", "trash_can": "residential trash bin, commercial dumpster",
    "road_sign": "street sign, construction sign", "traffic_light": "traffic signal light", "tree": "tree, overhanging branch",
    "trash": "dumped trash, debris, yard waste", "road_surface": "pothole, water, striping", "pole/utility": "pole, bollard, cable, cone",
    "other": "graffiti, street vendor, obstruction",
}
# End of the fixed values.


def looked_up(key: Column, table: Mapping, default) -> Column:
    """The table's value for the key, else the default."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, key), default if isinstance(default, Column) else F.lit(default))


def first_contained(text: Column, table: Sequence[tuple[str, str]], default: Column | str) -> Column:
    """The value of the first key, in order, that the text contains. A filter of a constant array, so that the plan and
    its code stay small however long the table is."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in table])
    hit = lambda t: F.get(F.filter(pairs, lambda p: t.contains(p["key"])), F.lit(0))["value"]
    return F.coalesce(bound(text, hit), default if isinstance(default, Column) else F.lit(default))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def coco_class(label: Column) -> Column:
    return looked_up(F.lower(label), COCO_TO_ALLOWED, "Other")


def step1_class(label: Column) -> Column:
    return looked_up(label, STEP1, "other")


def free_label(label: Column) -> Column:
    """An allowed class of that name in any case, else the first key contained, else Other."""
    names = {a.lower(): a for a in ALLOWED}
    return bound(F.lower(stripped(label)), lambda low: looked_up(low, names, first_contained(low, FREE_LABELS, "Other")))


def coco_id(index: Column) -> Column:
    """0-79 to the 1-90 numbering; other ids are raised by one."""
    return looked_up(index.cast("int"), dict(enumerate(COCO_IDS)), (index + 1).cast("int"))


def coco_name(index: Column) -> Column:
    return looked_up(index.cast("int"), dict(enumerate(COCO_NAMES)), F.concat(F.lit("class_"), index.cast("string")))


def prompt_key(label: Column) -> Column:
    return first_contained(F.lower(label), [(k, k) for k in PROMPT_KEYS], "other")


def region_route(label: Column) -> Column:
    """face, license_plate or other."""
    low = F.lower(label)
    face = low.contains("face") | low.contains("person") | low.contains("pedestrian")
    plate = low.contains("license") | low.contains("plate")
    return F.when(face, "face").when(plate, "license_plate").otherwise("other")


def allowed_file(name: Column, extensions: Sequence[str] = ("png", "jpg", "jpeg", "gif")) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(extensions) + ")$")


def safe_name(name: Column) -> Column:
    return F.translate(name, " ", "_")
