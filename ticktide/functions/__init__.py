"""ticktide.functions"""
