"""Fixed tables of land-cover and settlement classes."""

# Class ids and names of the land-cover map (LCCS), their IPCC classes, and settlement classes (SMOD).
LCCS = {
    0: "No Data",
    10: "Cropland, rainfed",
    11: "Herbaceous cover",
    12: "Tree or shrub cover",
    20: "Cropland, irrigated or post‐flooding",
    30: "Mosaic cropland (>50%) / natural vegetation (tree, shrub, herbaceous cover) (<50%)",
    40: "Mosaic natural vegetation (tree, shrub, herbaceous cover) (>50%) / cropland (<50%)",
    50: "Tree cover, broadleaved, evergreen, closed to open (>15%)",
    60: "Tree cover, broadleaved, deciduous, closed to open (>15%)",
    61: "Tree cover, broadleaved, deciduous, closed (>40%)",
    62: "Tree cover, broadleaved, deciduous, open (15‐40%)",
    70: "Tree cover, needleleaved, evergreen, closed to open (>15%)",
    71: "Tree cover, needleleaved, evergreen, closed (>40%)",
    72: "Tree cover, needleleaved, evergreen, open (15‐40%)",
    80: "Tree cover, needleleaved, deciduous, closed to open (>15%)",
    81: "Tree cover, needleleaved, deciduous, closed (>40%)",
    82: "Tree cover, needleleaved, deciduous, open (15‐40%)",
    90: "Tree cover, mixed leaf type (broadleaved and needleleaved)",
    100: "Mosaic tree and shrub (>50%) / herbaceous cover (<50%)",
    110: "Mosaic herbaceous cover (>50%) / tree and shrub (<50%)",
    120: "Shrubland",
    121: "Evergreen shrubland",
    122: "Deciduous shrubland",
    130: "Grassland",
    140: "Lichens and mosses",
    150: "Sparse vegetation (tree, shrub, herbaceous cover) (<15%)",
    152: "Sparse shrub (<15%)",
    153: "Sparse herbaceous cover (<15%)",
    160: "Tree cover, flooded, fresh or brakish water",
    170: "Tree cover, flooded, saline water",
    180: "Shrub or herbaceous cover, flooded, fresh/saline/brakish water",
    190: "Urban areas",
    200: "Bare areas",
    201: "Consolidated bare areas",
    202: "Unconsolidated bare areas",
    210: "Water bodies",
    220: "Permanent snow and ice",
}
IPCC = {
    0: "None",
    10: "Agriculture", 11: "Agriculture", 12: "Agriculture", 20: "Agriculture", 30: "Agriculture", 40: "Agriculture",
    50: "Forest", 60: "Forest", 61: "Forest", 62: "Forest", 70: "Forest", 71: "Forest", 72: "Forest", 80: "Forest", 81: "Forest", 82: "Forest", 90: "Forest", 100: "Forest",
    110: "Grassland",
    120: "Other", 121: "Other", 122: "Other",
    130: "Grassland",
    140: "Other", 150: "Other", 151: "Other", 152: "Other", 153: "Other",
    160: "Forest", 170: "Forest",
    180: "Wetland",
    190: "Settlement",
    200: "Other", 201: "Other", 202: "Other",
    210: "Water",
    220: "None",
}
SMOD = {10: "Water", 11: "Rural: Very Low Dens", 12: "Rural: Low Dens", 13: "Rural: cluster", 21: "Urban: Suburban", 22: "Urban: Semi-dense", 23: "Urban: Dense", 30: "Urban: Centre", 0: "None", -200: "Unknown"}
