"""Accessions of the imzML format."""

CONTINUOUS, PROCESSED = "IMS:1000030", "IMS:1000031"
X, Y, Z = "IMS:1000050", "IMS:1000051", "IMS:1000052"
OFFSET, LENGTH, BYTES = "IMS:1000102", "IMS:1000103", "IMS:1000104"
MZ, INTENSITY, ZLIB = "MS:1000514", "MS:1000515", "MS:1000574"
PIXEL_X, PIXEL_Y = "IMS:1000046", "IMS:1000047"
UUID = "IMS:1000080"
KINDS = {"MS:1000521": "<f4", "MS:1000523": "<f8", "MS:1000519": "<i4", "MS:1000522": "<i8"}
