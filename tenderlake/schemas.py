"""Column lists, types and the label dictionary of procurement records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import normal_label

# The columns of exported contracts and items, in order.
CONTRACT_COLUMNS = [
    "ContractNo", "GeneratedDate", "Buyer_Designation", "Buyer_ContactNo", "Buyer_EmailID", "Buyer_GSTIN", "Buyer_Address",
    "Seller_GeMSellerID", "Seller_CompanyName", "Seller_ContactNo", "Seller_EmailID", "Seller_Address",
    "Seller_MSMERegistrationNumber", "Seller_MSESocialCategory", "Seller_MSEGender", "Seller_GSTIN", "TotalOrderValueINR",
]
ORG_COLUMNS = ["Org_Type", "Org_Ministry", "Org_Department", "Org_OrganisationName", "Org_OfficeZone"]
PAYING_COLUMNS = ["Paying_Role", "Paying_PaymentMode", "Paying_Designation", "Paying_EmailID", "Paying_GSTIN", "Paying_Address"]
ITEM_COLUMNS = [
    "ContractNo", "ItemNo", "ProductName", "Brand", "BrandType", "CatalogueStatus", "SellingAs", "CategoryNameQuadrant", "Model",
    "HSNCode", "OrderedQuantity", "Unit", "UnitPriceINR", "TaxBifurcationINR", "PriceInclusiveINR",
]

# Group, label, column; the order within a label is the order of filling.
LABELS = [
    ("org", "type", "Org_Type"),
    ("org", "ministry", "Org_Ministry"),
    ("org", "department", "Org_Department"),
    ("org", "organisation name", "Org_OrganisationName"),
    ("org", "office zone", "Org_OfficeZone"),
    ("buyer", "designation", "Buyer_Designation"),
    ("buyer", "contact no", "Buyer_ContactNo"),
    ("buyer", "contact no.", "Buyer_ContactNo"),
    ("buyer", "contact", "Buyer_ContactNo"),
    ("buyer", "email id", "Buyer_EmailID"),
    ("buyer", "email", "Buyer_EmailID"),
    ("buyer", "gstin", "Buyer_GSTIN"),
    ("buyer", "address", "Buyer_Address"),
    ("paying", "role", "Paying_Role"),
    ("paying", "payment mode", "Paying_PaymentMode"),
    ("paying", "designation", "Paying_Designation"),
    ("paying", "email id", "Paying_EmailID"),
    ("paying", "gstin", "Paying_GSTIN"),
    ("paying", "address", "Paying_Address"),
    ("seller", "gem seller id", "Seller_GeMSellerID"),
    ("seller", "company name", "Seller_CompanyName"),
    ("seller", "contact no", "Seller_ContactNo"),
    ("seller", "contact", "Seller_ContactNo"),
    ("seller", "seller contact", "Seller_ContactNo"),
    ("seller", "email id", "Seller_EmailID"),
    ("seller", "address", "Seller_Address"),
    ("seller", "msme registration number", "Seller_MSMERegistrationNumber"),
    ("seller", "mse social category", "Seller_MSESocialCategory"),
    ("seller", "mse gender", "Seller_MSEGender"),
    ("seller", "gstin", "Seller_GSTIN"),
    ("product", "product name", "ProductName"),
    ("product", "brand", "Brand"),
    ("product", "brand type", "BrandType"),
    ("product", "catalogue status", "CatalogueStatus"),
    ("product", "selling as", "SellingAs"),
    ("product", "category name & quadrant", "CategoryNameQuadrant"),
    ("product", "category name and quadrant", "CategoryNameQuadrant"),
    ("product", "model", "Model"),
    ("product", "hsn code", "HSNCode"),
]

# Labels of contract texts, in lower case, that are no field of the dictionary.
OTHER_LABELS = ["contract no", "contract number", "contract date", "generated date", "total order value"]


def labels_dim(spark: SparkSession) -> DataFrame:
    """(grp, label, column, fill_order, norm_label): the dictionary, a fixed number of rows."""
    rows = [(g, x, c, k) for k, (g, x, c) in enumerate(LABELS)]
    return spark.createDataFrame(rows, "grp string, label string, column string, fill_order int").withColumn("norm_label", normal_label(F.col("label")))
