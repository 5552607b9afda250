"""Instruction templates for the three table tasks.

The texts must equal the reference's word for word (they are the
instructions of the published prompt corpora), so they are kept here as
fixed values, in their natural order.  ``{error_type}`` is substituted.
"""

from __future__ import annotations

# Task descriptions per task.
TASK_DESCRIPTIONS = {
    "generation": [
        "Modify a single attribute in the row identified by 'row_id' to introduce a {error_type} error. Ensure that the 'row_id' column is preserved as it uniquely identifies each record. Do NOT modify or generate new 'row_id' values.",
        "Introduce an error in a specific column of the row identified by 'row_id', creating a {error_type} error. The 'row_id' column must remain unchanged as it serves as the primary key, uniquely identifying each row, even if the table order is shuffled.",
        "Alter one column of a given row (selected using 'row_id') to create a {error_type} error. The row to be modified must be referenced using its 'row_id', which uniquely identifies each entry, regardless of the table order.",
        "Corrupt a single data entry in the row specified by 'row_id' to simulate a {error_type} error. Ensure 'row_id' is directly taken from the input table and remains unaltered.",
        "Modify a specific attribute in the row identified by 'row_id' to introduce a {error_type} error. Do NOT change or create new 'row_id' values.",
        "Change one column in the row determined by 'row_id' to generate a {error_type} error. The 'row_id' must be taken from the input table and remain unchanged.",
        "Introduce an error into a specific cell of the row identified by 'row_id', resulting in a {error_type} error. The 'row_id' serves as a fixed identifier and should not be modified.",
    ],
    "detection": [
        "Examine the input table and identify a cell in the row specified by 'row_id' that contains a {error_type} error. The 'row_id' uniquely identifies each record and must be taken directly from the input table without modification.",
        "Analyze the input table to find a {error_type} error in a specific column of a row identified by 'row_id'. The 'row_id' must remain unchanged and must be directly referenced from the input table.",
        "Detect a {error_type} error by locating a single erroneous cell in the row specified by 'row_id'. Ensure 'row_id' is preserved as the primary key and remains unaltered.",
        "Review the table and identify an incorrect value in a column of a row determined by 'row_id'. The detected error must be recorded with its exact 'row_id' and column name.",
        "Pinpoint a {error_type} error in the table, ensuring the erroneous cell belongs to a valid 'row_id' from the input table. Record the incorrect value in 'error_value'.",
        "Inspect the table and find a {error_type} error in a specific column of a given 'row_id'. Do NOT modify or generate new 'row_id' values.",
        "Search the input table for a {error_type} error and log its exact position. Ensure that 'row_id' is taken from the input table and is not altered.",
        "Identify a single incorrect data entry that qualifies as a {error_type} error, ensuring that 'row_id' is selected from the input table and remains unchanged.",
        "Detect an erroneous cell in the table that represents a {error_type} issue. The detected row must be referenced using its 'row_id', and the original incorrect value should be stored in 'error_value'.",
        "Find a {error_type} error in the table and document the corresponding 'row_id', column, and incorrect value while ensuring 'row_id' is directly taken from the input table.",
    ],
    "correction": [
        "Identify and correct a {error_type} error in the row specified by 'row_id'. The 'row_id' uniquely identifies each record and must be taken directly from the input table without modification.",
        "Find a {error_type} error in a specific column of the row identified by 'row_id' and replace it with the correct value. The 'row_id' must remain unchanged as it serves as the primary key.",
        "Detect and fix a {error_type} error by determining the correct value for the erroneous entry in the row specified by 'row_id'. Do NOT modify or generate new 'row_id' values.",
        "Locate an incorrect value in a column of the row identified by 'row_id' and provide the correct replacement. The 'row_id' must be directly referenced from the input table.",
        "Review the table, identify a {error_type} error in a specific row, and replace the erroneous value with the correct one. The 'row_id' must not be altered.",
        "Analyze the input table, find a {error_type} error in a row determined by 'row_id', and correct it by generating the appropriate value.",
        "Detect an incorrect value in the table that qualifies as a {error_type} error and replace it with an accurate entry while preserving 'row_id' from the input table.",
        "Find a {error_type} error in a given row, using 'row_id' as a fixed reference, and provide the correct value while ensuring 'row_id' remains unchanged.",
        "Search the table for a {error_type} error and generate the correct value to replace it. The erroneous value must be recorded, and the correction stored in 'right_value'.",
        "Locate a {error_type} error in the row identified by 'row_id' and return its correct value. Ensure that 'row_id' remains unchanged from the input table.",
    ],
}

# Error-type descriptions (shared by all tasks).
ERROR_TYPE_DESCRIPTIONS = {
    "rule_violation": [
        "Rule violations occur when data entries fail to satisfy predefined integrity constraints, such as uniqueness, referential integrity, or functional dependencies. Populate the 'tuple_pairs' field with violating tuples and the 'constraint' field with the broken rule.",
        "A rule violation happens when data contradicts database constraints, leading to inconsistencies and reducing overall data reliability. The 'tuple_pairs' field should contain the conflicting tuples, and 'constraint' should specify the violated rule.",
        "Rule violations include duplicate primary keys, conflicting attribute values, and invalid foreign key references within a dataset_old. Fill 'tuple_pairs' with related erroneous tuples and 'constraint' with the specific constraint that was violated.",
        "A rule violation represents a logical inconsistency where data fails to meet structural constraints, potentially causing errors in downstream applications. Ensure 'tuple_pairs' lists the affected tuples and 'constraint' details the violated integrity rule.",
    ],
    "pattern_violation": [
        "Pattern violations refer to data values that do not conform to expected syntax, structure, or semantic constraints.",
        "A pattern violation occurs when a data entry deviates from its expected format, such as incorrect date formats or improperly structured email addresses.",
        "Pattern violations include formatting errors, misplaced values, and syntax inconsistencies that disrupt data processing and interpretation.",
        "A pattern violation is an incorrect representation of data that fails to match predefined format rules, affecting readability and usability.",
    ],
    "outliers": [
        "Outliers are data points that significantly deviate from the expected distribution within a column, either numerically or categorically.",
        "Outliers represent extreme or unexpected values in a dataset_old that do not conform to the general pattern of the data.",
        "Outliers are anomalies in numerical or categorical data that can distort statistical analysis and impact decision-making.",
        "Outliers occur when data values fall outside the typical range, often due to measurement errors or data entry mistakes.",
    ],
    "missing_value": [
        "Missing values refer to data cells that are empty, incorrectly filled, or implicitly missing due to format conversion issues or inconsistent data integration.",
        "A missing value is an absent or null entry in a dataset_old, which can lead to incomplete analysis and unreliable predictions.",
        "Missing values occur when essential data is unavailable, either due to collection errors, manual omissions, or placeholder values like 'N/A'.",
        "Missing data represents gaps in a dataset_old where values are expected but not provided, potentially introducing bias in analysis.",
    ],
}

UNKNOWN_ERROR_TYPE = "Unknown error type."

# Output-format suffixes per task.
SUFFIXES = {
    "generation": [
        "Provide the final result as a JSON object with 'row_id', 'column', 'error_type', 'error_value', 'right_value', 'missing_value', 'constraint', and 'tuple_pairs'. Select 'row_id' from the input table, modify only a single column, store the correct value in 'right_value', and the erroneous value in 'error_value'. Only include erroneous cell with high confidence.",
        "Output a JSON object containing 'row_id', 'column', 'error_type', 'error_value', 'right_value', 'missing_value', 'constraint', and 'tuple_pairs'. The 'row_id' must be from the input table, and the modified column’s correct value should be recorded in 'right_value', with the introduced error in 'error_value'. Report only error you are highly confident about.",
        "Generate a JSON result with 'row_id', 'column', 'error_type', 'error_value', 'right_value', 'missing_value', 'constraint', and 'tuple_pairs'. Ensure that 'row_id' is taken from the input table, the original correct value is placed in 'right_value', and the incorrect generated value is stored in 'error_value'. Include only high-confidence erroneous cell.",
        "Return a JSON object structured with 'row_id', 'column', 'error_type', 'error_value', 'right_value', 'missing_value', 'constraint', and 'tuple_pairs'. The 'row_id' must not be altered, and the original value should be saved in 'right_value' while the generated incorrect value should be placed in 'error_value'. Report only error with high certainty.",
        "Provide a JSON output including 'row_id', 'column', 'error_type', 'error_value', 'right_value', 'missing_value', 'constraint', and 'tuple_pairs'. The modified column's original data must be stored in 'right_value', and the generated incorrect entry should be recorded in 'error_value'. Only return error with high confidence.",
        "Output a structured JSON object with 'row_id', 'column', 'error_type', 'error_value', 'right_value', 'missing_value', 'constraint', and 'tuple_pairs'. The 'row_id' must come from the input table, and only a single column should be modified. Keep the correct value in 'right_value' and the incorrect generated value in 'error_value'. Only include confident error.",
        "Generate a JSON object containing 'row_id', 'column', 'error_type', 'error_value', 'right_value', 'missing_value', 'constraint', and 'tuple_pairs'. Ensure that 'row_id' is extracted from the input table, the modified column’s original value is recorded in 'right_value', and the erroneous value is stored in 'error_value'. Share only error with high certainty.",
    ],
    "detection": [
        "Return the final result as a JSON object with 'row_id', 'column', 'error_type', and 'error_value'. The 'row_id' must be taken from the input table without modification, 'column' must specify the affected field, and 'error_value' must store the detected erroneous value.",
        "Provide the output as a JSON object containing 'row_id', 'column', 'error_type', and 'error_value'. Ensure that 'row_id' is directly referenced from the input table and 'error_value' contains the original incorrect data. Only include confident cell.",
        "Generate a JSON response with 'row_id', 'column', 'error_type', and 'error_value'. The 'row_id' should come from the input table, and 'error_value' must capture the detected incorrect value without modification. Only include erroneous cell with high confidence.",
        "Output a structured JSON object including 'row_id', 'column', 'error_type', and 'error_value'. The 'row_id' must be extracted from the input table, and 'error_value' should store the exact erroneous value from the detected cell. Share only cell with high certainty.",
        "Return a JSON object with 'row_id', 'column', 'error_type', and 'error_value'. The 'row_id' must strictly match an existing record in the input table, and 'error_value' should contain the original incorrect value found in that row. Share only cell with high certainty.",
        "Provide a JSON output containing 'row_id', 'column', 'error_type', and 'error_value'. Ensure that 'row_id' remains unchanged from the input table and 'error_value' reflects the erroneous entry as detected. Report only cell you are highly confident about.",
        "Generate a JSON result formatted with 'row_id', 'column', 'error_type', and 'error_value'. The 'row_id' must be directly selected from the input table, and 'error_value' must store the incorrect data exactly as found. Only include confident cell.",
        "Construct a JSON object with 'row_id', 'column', 'error_type', and 'error_value'. Ensure that 'row_id' is taken from the input table, and 'error_value' correctly reflects the detected erroneous data entry. Only return cell with high confidence.",
    ],
    "correction": [
        "Return the final result as a JSON object with 'row_id', 'column', 'error_type', 'error_value', 'right_value', 'missing_value', 'constraint', and 'tuple_pairs'. The 'row_id' must be selected from the input table, 'column' must specify the affected field, 'error_value' must store the detected incorrect value, and 'right_value' must contain the correct replacement.",
        "Provide the output as a JSON object containing 'row_id', 'column', 'error_type', 'error_value', 'right_value', 'missing_value', 'constraint', and 'tuple_pairs'. The 'row_id' must be taken directly from the input table, 'error_value' should reflect the erroneous entry, and 'right_value' should store the corrected value.",
        "Generate a JSON response with 'row_id', 'column', 'error_type', 'error_value', and 'right_value'. The 'row_id' must remain unchanged from the input table, the incorrect value must be recorded in 'error_value', and the correction must be stored in 'right_value'. Only return cell with high confidence.",
        "Output a structured JSON object including 'row_id', 'column', 'error_type', 'error_value', and 'right_value'. Ensure that 'row_id' comes from the input table, 'error_value' reflects the detected erroneous data, and 'right_value' holds the correct value. Only return cell with high confidence.",
        "Return a JSON object with 'row_id', 'column', 'error_type', 'error_value', and 'right_value'. The 'row_id' must strictly match an existing record in the input table, the incorrect value should be stored in 'error_value', and the correct replacement should be provided in 'right_value'.",
        "Provide a JSON output containing 'row_id', 'column', 'error_type', 'error_value', and 'right_value'. Ensure that 'row_id' is taken from the input table, 'error_value' represents the original incorrect value, and 'right_value' stores the correct replacement. Share only cell with high certainty.",
        "Generate a JSON object formatted with 'row_id', 'column', 'error_type', 'error_value', and 'right_value'. The 'row_id' must be directly selected from the input table, 'error_value' should reflect the detected incorrect data, and 'right_value' must store the corrected value. Share only cell with high certainty.",
        "Construct a JSON object with 'row_id', 'column', 'error_type', 'error_value', and 'right_value'. Ensure that 'row_id' is extracted from the input table, 'error_value' holds the incorrect data, and 'right_value' contains the correct value. Only return cell with high confidence.",
    ],
}

# which table a task shows as input: generation edits the clean table,
# detection and correction read the dirty one
TASK_SOURCE = {"generation": "clean", "detection": "dirty", "correction": "dirty"}
TASKS = ("generation", "detection", "correction")
