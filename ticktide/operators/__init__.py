"""ticktide.operators"""
